"""Analysis settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

ERROR, WARNING, INFORMATION, HINT = 0, 1, 2, 3
SEVERITIES = {"error": ERROR, "warning": WARNING, "information": INFORMATION, "hint": HINT}

UNDEFINED, HARDCODED, FALLBACK, INLINE = "variableNoDefinida", "valorHardcoded", "fallbackHardcoded", "cssInlineReact"

STYLE_LANGUAGES = ("css", "scss", "sass", "less", "vue", "html")
REACT_LANGUAGES = ("typescriptreact", "javascriptreact")
#: Languages in which each editor feature answers.
ACTION_LANGUAGES = ("css", "scss", "less", "vue", "typescriptreact", "javascriptreact")
HOVER_LANGUAGES = COMPLETION_LANGUAGES = ("css", "scss", "less", "vue")

MAX_DEPTH = 10
SUGGESTIONS, SIMILAR, COMPLETIONS_IN_VAR, COMPLETIONS_BEFORE_VAR, EXAMPLES = 3, 3, 50, 5, 3

# Default properties to check, allowed values, globs and keywords.
PROPERTIES = {
    "font-size": True,
    "color": True,
    "background-color": True,
    "background": True,
    "border-color": True,
    "margin": False,
    "padding": False,
    "gap": False,
    "border-radius": False,
}
ALLOWED = ("0", "auto", "inherit", "initial", "unset", "none", "100%", "50%", "transparent", "currentColor")
VARIABLE_FILES = ("**/variables.css", "**/vars.css", "**/_variables.scss", "**/tokens.css")
EXCLUDED = ("**/node_modules/**", "**/vendor/**", "**/*.min.css", "**/dist/**", "**/build/**")
KEYWORDS = {
    "font-size": ["font", "size", "fs", "text", "tipo"],
    "font-family": ["font", "family", "tipo"],
    "font-weight": ["font", "weight", "fw"],
    "line-height": ["line", "height", "lh"],
    "color": ["color", "clr", "text", "primary", "secondary"],
    "background-color": ["bg", "background", "fondo"],
    "background": ["bg", "background", "fondo"],
    "border-color": ["border", "borde", "color"],
    "border-radius": ["radius", "round", "borde"],
    "gap": ["space", "gap", "espacio"],
    "margin": ["space", "margin", "espacio"],
    "padding": ["space", "padding", "espacio"],
    "width": ["width", "size", "ancho"],
    "height": ["height", "size", "alto"],
    "box-shadow": ["shadow", "sombra"],
    "z-index": ["z", "index", "layer"],
    "transition": ["transition", "duration", "ease"],
    "opacity": ["opacity", "alpha"],
}
COLOR_HINTS = ("color", "background", "background-color", "border-color")


@dataclass(frozen=True)
class AnalyzerConfig:
    """What to scan, what to report and how severely. All driver-side constants."""

    enabled: bool = True
    variable_files: tuple[str, ...] = VARIABLE_FILES
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = EXCLUDED
    scan_all_files: bool = False
    hardcoded_enabled: bool = True
    hardcoded_severity: int = WARNING
    properties: dict[str, bool] = field(default_factory=lambda: dict(PROPERTIES))
    allowed: tuple[str, ...] = ALLOWED
    inline_enabled: bool = True
    inline_severity: int = ERROR
    keywords: dict[str, list[str]] = field(default_factory=lambda: dict(KEYWORDS))
    roots: tuple[str, ...] = ()
    count_uses: bool = False
