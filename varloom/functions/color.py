"""Colours: recognition, parsing, conversion, contrast, nearest name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.functions.text import WS, js_trim, let

# The CSS named colours.
NAMED = {
    name: code
    for name, code in (
        line.split()
        for line in """
aliceblue #f0f8ff
antiquewhite #faebd7
aqua #00ffff
aquamarine #7fffd4
azure #f0ffff
beige #f5f5dc
bisque #ffe4c4
black #000000
blanchedalmond #ffebcd
blue #0000ff
blueviolet #8a2be2
brown #a52a2a
burlywood #deb887
cadetblue #5f9ea0
chartreuse #7fff00
chocolate #d2691e
coral #ff7f50
cornflowerblue #6495ed
cornsilk #fff8dc
crimson #dc143c
cyan #00ffff
darkblue #00008b
darkcyan #008b8b
darkgoldenrod #b8860b
darkgray #a9a9a9
darkgreen #006400
darkgrey #a9a9a9
darkkhaki #bdb76b
darkmagenta #8b008b
darkolivegreen #556b2f
darkorange #ff8c00
darkorchid #9932cc
darkred #8b0000
darksalmon #e9967a
darkseagreen #8fbc8f
darkslateblue #483d8b
darkslategray #2f4f4f
darkslategrey #2f4f4f
darkturquoise #00ced1
darkviolet #9400d3
deeppink #ff1493
deepskyblue #00bfff
dimgray #696969
dimgrey #696969
dodgerblue #1e90ff
firebrick #b22222
floralwhite #fffaf0
forestgreen #228b22
fuchsia #ff00ff
gainsboro #dcdcdc
ghostwhite #f8f8ff
gold #ffd700
goldenrod #daa520
gray #808080
green #008000
greenyellow #adff2f
grey #808080
honeydew #f0fff0
hotpink #ff69b4
indianred #cd5c5c
indigo #4b0082
ivory #fffff0
khaki #f0e68c
lavender #e6e6fa
lavenderblush #fff0f5
lawngreen #7cfc00
lemonchiffon #fffacd
lightblue #add8e6
lightcoral #f08080
lightcyan #e0ffff
lightgoldenrodyellow #fafad2
lightgray #d3d3d3
lightgreen #90ee90
lightgrey #d3d3d3
lightpink #ffb6c1
lightsalmon #ffa07a
lightseagreen #20b2aa
lightskyblue #87cefa
lightslategray #778899
lightslategrey #778899
lightsteelblue #b0c4de
lightyellow #ffffe0
lime #00ff00
limegreen #32cd32
linen #faf0e6
magenta #ff00ff
maroon #800000
mediumaquamarine #66cdaa
mediumblue #0000cd
mediumorchid #ba55d3
mediumpurple #9370db
mediumseagreen #3cb371
mediumslateblue #7b68ee
mediumspringgreen #00fa9a
mediumturquoise #48d1cc
mediumvioletred #c71585
midnightblue #191970
mintcream #f5fffa
mistyrose #ffe4e1
moccasin #ffe4b5
navajowhite #ffdead
navy #000080
oldlace #fdf5e6
olive #808000
olivedrab #6b8e23
orange #ffa500
orangered #ff4500
orchid #da70d6
palegoldenrod #eee8aa
palegreen #98fb98
paleturquoise #afeeee
palevioletred #db7093
papayawhip #ffefd5
peachpuff #ffdab9
peru #cd853f
pink #ffc0cb
plum #dda0dd
powderblue #b0e0e6
purple #800080
rebeccapurple #663399
red #ff0000
rosybrown #bc8f8f
royalblue #4169e1
saddlebrown #8b4513
salmon #fa8072
sandybrown #f4a460
seagreen #2e8b57
seashell #fff5ee
sienna #a0522d
silver #c0c0c0
skyblue #87ceeb
slateblue #6a5acd
slategray #708090
slategrey #708090
snow #fffafa
springgreen #00ff7f
steelblue #4682b4
tan #d2b48c
teal #008080
thistle #d8bfd8
tomato #ff6347
turquoise #40e0d0
violet #ee82ee
wheat #f5deb3
white #ffffff
whitesmoke #f5f5f5
yellow #ffff00
yellowgreen #9acd32
transparent transparent
""".split("\n")
        if line
    )
}

_N, _S = r"(\d{1,3})", f"[{WS}]"
#: Functional notations: name, pattern, whether percentages follow the first number.
FUNCTIONAL = {
    "rgb": rf"(?i)^rgb\({_S}*{_N}{_S}*,{_S}*{_N}{_S}*,{_S}*{_N}{_S}*\)\z",
    "rgba": rf"(?i)^rgba\({_S}*{_N}{_S}*,{_S}*{_N}{_S}*,{_S}*{_N}{_S}*,{_S}*([\d.]+){_S}*\)\z",
    "rgb_blank": rf"(?i)^rgb\({_S}*{_N}{_S}+{_N}{_S}+{_N}{_S}*(?:/{_S}*([\d.]+%?))?{_S}*\)\z",
    "hsl": rf"(?i)^hsl\({_S}*{_N}{_S}*,{_S}*{_N}%{_S}*,{_S}*{_N}%{_S}*\)\z",
    "hsla": rf"(?i)^hsla\({_S}*{_N}{_S}*,{_S}*{_N}%{_S}*,{_S}*{_N}%{_S}*,{_S}*([\d.]+){_S}*\)\z",
    "hsl_blank": rf"(?i)^hsl\({_S}*{_N}{_S}+{_N}%{_S}+{_N}%{_S}*(?:/{_S}*([\d.]+%?))?{_S}*\)\z",
}
HEX = r"^#(?:[0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})\z"
COLOR_TYPE = "struct<format:string,r:int,g:int,b:int,a:double,original:string,hex:string>"


def _codes() -> Column:
    """Map of names to codes, as one constant."""
    return F.str_to_map(F.lit(",".join(f"{n}:{c}" for n, c in NAMED.items())), F.lit(","), F.lit(":"))


def is_color(value: Column) -> Column:
    """Whether a value, trimmed and lower-cased, is a named, hexadecimal or functional colour."""
    return let(F.lower(js_trim(value)), lambda clean: clean.isin(*NAMED) | clean.rlike(HEX) | (F.contains(clean, F.lit("(")) & reduce(lambda a, b: a | b, [clean.rlike(p) for p in FUNCTIONAL.values()])))


def _byte(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


def hex_to_rgb(code: Column) -> Column:
    """struct<r,g,b> of six hexadecimal digits with or without #; black for anything else."""
    plain = F.regexp_replace(code, "^#", "")
    ok = F.coalesce(plain.rlike(r"(?i)^[0-9a-f]{6}\z"), F.lit(False))
    return F.struct(*[F.when(ok, _byte(F.substring(plain, k, 2))).otherwise(F.lit(0)).alias(n) for n, k in (("r", 1), ("g", 3), ("b", 5))])


def rgb_to_hex(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """# and two digits for each channel, clamped; an alpha byte only where alpha is below 1."""
    two = lambda x: F.lower(F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("long")), 2, "0"))
    out = F.concat(F.lit("#"), two(r), two(g), two(b))
    return out if a is None else F.when(a < 1, F.concat(out, two(a * 255))).otherwise(out)


def hsl_to_rgb(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """struct<r,g,b> from degrees and percentages; a hue of 360 or more has no sector."""
    chroma = lambda v: (F.lit(1.0) - F.abs(2 * v["l"] - 1)) * v["s"]
    mixed = let(
        let(F.struct(h.alias("h"), (s / 100.0).alias("s"), (l / 100.0).alias("l")), lambda v: F.struct(v["h"].alias("h"), v["l"].alias("l"), chroma(v).alias("c"))),
        lambda v: F.struct(v["h"].alias("h"), v["c"].alias("c"), (v["c"] * (F.lit(1.0) - F.abs((v["h"] / 60.0) % 2 - 1))).alias("x"), (v["l"] - v["c"] / 2).alias("m")),
    )

    def channels(v: Column) -> Column:
        zero, hue = F.lit(0.0), v["h"]
        sector = lambda *six: F.when(hue < 60, six[0]).when(hue < 120, six[1]).when(hue < 180, six[2]).when(hue < 240, six[3]).when(hue < 300, six[4]).when(hue < 360, six[5]).otherwise(zero)
        full = lambda e: F.floor((e + v["m"]) * 255 + 0.5).cast("int")
        c, x = v["c"], v["x"]
        return F.struct(full(sector(c, x, zero, zero, x, c)).alias("r"), full(sector(x, c, c, x, zero, zero)).alias("g"), full(sector(zero, zero, x, c, c, x)).alias("b"))

    return let(mixed, channels)


def _number(text: Column) -> Column:
    """The longest numeric beginning, as parseFloat reads it."""
    return F.regexp_extract(text, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def parse_color(value: Column) -> Column:
    """Colour struct, or null. Names and hexadecimal forms are trimmed first; functional forms are not."""
    both = let(F.struct(value.alias("v"), F.lower(js_trim(value)).alias("clean")), lambda x: F.struct(x["v"].alias("v"), x["clean"].alias("clean"), F.element_at(_codes(), x["clean"]).alias("code")))
    return let(both, lambda x: _parse(x["v"], x["clean"], x["code"]))


def _parse(value: Column, clean: Column, name_code: Column) -> Column:
    one = F.lit(1.0)

    def color(form, r, g, b, a, code) -> Column:
        return F.struct(form.alias("format"), r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), a.cast("double").alias("a"), value.alias("original"), code.alias("hex")).cast(COLOR_TYPE)

    rgb = hex_to_rgb(name_code)
    clear = name_code == "transparent"
    named = color(F.lit("named"), rgb["r"], rgb["g"], rgb["b"], F.when(clear, F.lit(0.0)).otherwise(one), F.when(clear, "#00000000").otherwise(name_code))
    digit = lambda k: _byte(F.concat(F.substring(clean, k, 1), F.substring(clean, k, 1)))
    pair = lambda k: _byte(F.substring(clean, k, 2))
    alpha4, alpha8 = digit(5) / 255.0, pair(8) / 255.0
    short = color(F.lit("hex"), digit(2), digit(3), digit(4), one, rgb_to_hex(digit(2), digit(3), digit(4)))
    short4 = color(F.lit("hex"), digit(2), digit(3), digit(4), alpha4, rgb_to_hex(digit(2), digit(3), digit(4), alpha4))
    long6 = color(F.lit("hex"), pair(2), pair(4), pair(6), one, clean)
    long8 = color(F.lit("hex"), pair(2), pair(4), pair(6), alpha8, clean)
    out = (
        F.when(name_code.isNotNull(), named).when(clean.rlike(r"^#[0-9a-f]{3}\z"), short).when(clean.rlike(r"^#[0-9a-f]{4}\z"), short4)
        .when(clean.rlike(r"^#[0-9a-f]{6}\z"), long6).when(clean.rlike(r"^#[0-9a-f]{8}\z"), long8)
    )
    for kind, pattern in FUNCTIONAL.items():
        out = out.when(value.rlike(pattern), _functional(value, kind, pattern, color))
    return out


def _functional(value: Column, kind: str, pattern: str, color) -> Column:
    """Colour of a value in one functional notation."""
    part = lambda k: F.regexp_extract(value, pattern, k)
    base = kind[:3]
    if kind[-1] == "a":
        a = _number(part(4))
    elif kind.endswith("_blank"):
        a = let(part(4), lambda raw: F.when(raw == "", F.lit(1.0)).otherwise(F.when(F.endswith(raw, F.lit("%")), _number(raw) / 100).otherwise(_number(raw))))
    else:
        a = F.lit(1.0)
    n = [part(k).try_cast("int") for k in (1, 2, 3)]
    rgb = F.struct(*[x.alias(c) for x, c in zip(n, "rgb", strict=True)]) if base == "rgb" else hsl_to_rgb(*n)

    def whole(q: Column) -> Column:
        r, g, b, alpha = q["rgb"]["r"], q["rgb"]["g"], q["rgb"]["b"], q["a"]
        form = F.when(alpha < 1, base + "a").otherwise(base) if kind.endswith("_blank") else F.lit(kind)
        return color(form, r, g, b, alpha, rgb_to_hex(r, g, b, alpha))

    return let(F.struct(rgb.alias("rgb"), a.alias("a")), whole)


def rgb_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two colour structs; alpha does not count."""
    return F.sqrt(sum((F.pow((a[c] - b[c]).cast("double"), F.lit(2.0)) for c in ("r", "g", "b")), F.lit(0.0)))


def luminance(c: Column) -> Column:
    """Relative luminance (WCAG 2.0)."""

    def linear(v: Column) -> Column:
        s = v / 255.0
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(c["r"]) + 0.7152 * linear(c["g"]) + 0.0722 * linear(c["b"])


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio (WCAG 2.0)."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def nearest_name(c: Column) -> Column:
    """Name of the nearest opaque named colour, the first of equals, if nearer than 50."""
    names = [n for n in NAMED if n != "transparent"]
    squares = []
    for k, name in enumerate(names):
        r, g, b = (int(NAMED[name][i : i + 2], 16) for i in (1, 3, 5))
        squares.append(sum(((c[x] - v) * (c[x] - v) for x, v in zip("gb", (g, b), strict=True)), (c["r"] - r) * (c["r"] - r)) * 256 + k)
    # the square of the distance and the name's number in one; the last, which no name has, bounds the distance
    best = F.least(*squares, F.lit((50 * 50 - 1) * 256 + 255))
    return F.get(F.array(*[F.lit(n) for n in names]), best % 256)


def preview_markdown(c: Column) -> Column:
    """Picture of a colour as an inline SVG, and its codes."""
    return let(c, _preview)


def _preview(c: Column) -> Column:
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="16" height="16">\n        <rect width="16" height="16" fill="'), c["hex"], F.lit('" stroke="#888" stroke-width="1"/>\n    </svg>'))
    code = F.regexp_replace(F.base64(F.encode(svg, "UTF-8")), r"[\r\n]", "")
    lines = F.concat(
        F.lit("![color](data:image/svg+xml;base64,"), code, F.lit(") **"), c["original"], F.lit("**\n\n- **HEX:** `"), c["hex"],
        F.lit("`\n- **RGB:** `rgb("), c["r"], F.lit(", "), c["g"], F.lit(", "), c["b"], F.lit(")`"),
    )
    return F.when(c["a"] < 1, F.concat(lines, F.lit("\n- **Alpha:** `"), F.format_string("%.2f", c["a"]), F.lit("`"))).otherwise(lines)
