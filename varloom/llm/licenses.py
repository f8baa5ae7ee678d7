"""Licence recognition: sentences to sentence identifiers, identifier sequences to licences."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentence -> sentence identifier. A line or clause of a licence notice, lower case, letters, digits, dots inside numbers and single blanks.
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheRef2",
    "licensed under the apache license version 2.0 the license": "ApacheRef2",
    "this file is licensed under the apache license version 2.0": "ApacheRef2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ObtainCopy",
    "spdx license identifier apache 2.0": "ApacheSpdx",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "this software is released under the mit license": "MitRef",
    "the mit license": "MitTitle",
    "mit license": "MitTitle",
    "spdx license identifier mit": "MitSpdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "spdx license identifier bsd 3 clause": "Bsd3Spdx",
    "spdx license identifier bsd 2 clause": "Bsd2Spdx",
    "licensed under the bsd license": "BsdRef",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "released under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "spdx license identifier gpl 3.0 only": "Gpl3Spdx",
    "spdx license identifier gpl 3.0 or later": "Gpl3PlusSpdx",
    "spdx license identifier gpl 2.0 only": "Gpl2Spdx",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "Mpl2Ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "Mpl2Copy",
    "spdx license identifier mpl 2.0": "Mpl2Spdx",
    "licensed under cc by nc 4.0": "CcByNc4",
    "licensed under cc by 4.0": "CcBy4",
    "licensed under cc by sa 4.0": "CcBySa4",
    "licensed under cc by nc sa 4.0": "CcByNcSa4",
    "licensed under cc0 1.0": "Cc0",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CcByNc4",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CcBySa4",
    "all rights reserved": "AllRights",
}

#: Ordered rules: the first that matches consumes its identifiers. Identifier sequence -> licence.
RULES = [
    ("ApacheRef2 ApacheComply ObtainCopy", "Apache-2.0"),
    ("ApacheRef2 ApacheComply", "Apache-2.0"),
    ("ApacheRef2", "Apache-2.0"),
    ("ApacheSpdx", "Apache-2.0"),
    ("MitTitle MitGrant MitNotice", "MIT"),
    ("MitGrant MitNotice", "MIT"),
    ("MitGrant", "MIT"),
    ("MitRef", "MIT"),
    ("MitSpdx", "MIT"),
    ("MitTitle", "MIT"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary", "BSD-2-Clause"),
    ("BsdGrant BsdSource", "BSD-1-Clause"),
    ("Bsd3Spdx", "BSD-3-Clause"),
    ("Bsd2Spdx", "BSD-2-Clause"),
    ("BsdRef", "BSD"),
    ("Gpl3Grant GplWarranty GplCopy", "GPL-3.0-or-later"),
    ("Gpl3Grant GplWarranty", "GPL-3.0-or-later"),
    ("Gpl3Grant", "GPL-3.0-or-later"),
    ("Gpl2Grant GplWarranty GplCopy", "GPL-2.0-or-later"),
    ("Gpl2Grant GplWarranty", "GPL-2.0-or-later"),
    ("Gpl2Grant", "GPL-2.0-or-later"),
    ("Gpl3PlusSpdx", "GPL-3.0-or-later"),
    ("Gpl3Spdx", "GPL-3.0-only"),
    ("Gpl2Spdx", "GPL-2.0-only"),
    ("Gpl3Ref", "GPL-3.0-only"),
    ("Gpl2Ref", "GPL-2.0-only"),
    ("Mpl2Ref Mpl2Copy", "MPL-2.0"),
    ("Mpl2Ref", "MPL-2.0"),
    ("Mpl2Spdx", "MPL-2.0"),
    ("CcByNcSa4", "CC-BY-NC-SA-4.0"),
    ("CcByNc4", "CC-BY-NC-4.0"),
    ("CcBySa4", "CC-BY-SA-4.0"),
    ("CcBy4", "CC-BY-4.0"),
    ("Cc0", "CC0-1.0"),
]

#: SPDX identifiers beyond those above, each with names that follow "licensed under".
COMMON = {
    "LGPL-2.1-only": ["gnu lesser general public license version 2.1", "gnu lgpl version 2.1", "lgpl v2.1", "lgpl 2.1"],
    "LGPL-2.1-or-later": [],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license version 3.0", "gnu lgpl version 3", "lgpl v3", "lgpl 3.0"],
    "LGPL-3.0-or-later": [],
    "LGPL-2.0-only": [],
    "LGPL-2.0-or-later": [],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license version 3.0", "gnu agpl version 3", "agpl v3", "agpl 3.0"],
    "AGPL-3.0-or-later": [],
    "GPL-1.0-or-later": [],
    "GPL-2.0-only": ["gnu general public license version 2.0", "gnu gpl version 2", "gnu gpl v2", "gpl v2", "gpl 2.0"],
    "GPL-2.0-or-later": [],
    "GPL-3.0-only": ["gnu general public license version 3.0", "gnu gpl version 3", "gnu gpl v3", "gpl v3", "gpl 3.0"],
    "GPL-3.0-or-later": [],
    "Apache-1.1": ["apache license version 1.1"],
    "Apache-2.0": ["apache license 2.0", "apache license v2.0", "apache 2.0 license"],
    "MIT": ["mit", "mit licence"],
    "MIT-0": ["mit no attribution license"],
    "ISC": ["isc license"],
    "0BSD": ["zero clause bsd license"],
    "BSD-1-Clause": [],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "EPL-1.0": ["eclipse public license version 1.0", "eclipse public license v1.0", "eclipse public license 1.0"],
    "EPL-2.0": ["eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license 2.0"],
    "MPL-1.1": ["mozilla public license version 1.1"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v 2.0", "mpl 2.0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1.0"],
    "CC0-1.0": ["cc0"],
    "CC-BY-4.0": ["creative commons attribution 4.0"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4.0", "creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-NC-SA-4.0": ["creative commons attribution noncommercial sharealike 4.0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0 international license"],
}
#: Sentences of further notices, by identifier and licence.
NOTICES = [
    (f"this {thing} is free software you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free software foundation {version}", f"{key}Grant", name)
    for thing in ("program", "library", "software", "file")
    for kind, number, key, name in (("lesser general", "2.1", "Lgpl21", "LGPL-2.1"), ("lesser general", "3", "Lgpl3", "LGPL-3.0"), ("affero general", "3", "Agpl3", "AGPL-3.0"))
    for version, key, name in ((f"either version {number} of the license or at your option any later version", key + "Plus", name + "-or-later"), (f"version {number} of the license", key + "Only", name + "-only"), (f"version {number}", key + "Only", name + "-only"))
] + [
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "IscGrant", "ISC"),
    ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "IscGrant", "ISC"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "ZeroBsdGrant", "0BSD"),
    ("isc license", "IscTitle", "ISC"),
    ("the isc license", "IscTitle", "ISC"),
    ("this is free and unencumbered software released into the public domain", "UnlicenseGrant", "Unlicense"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "ZlibGrant", "Zlib"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0", "Epl2Grant", "EPL-2.0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution and is available at https www.eclipse.org legal epl v20.html", "Epl2Grant", "EPL-2.0"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl v10.html", "Epl1Grant", "EPL-1.0"),
]
SPDX = "spdx license identifier "
for _name, _refs in COMMON.items():
    _id = "Id" + re.sub(r"[^A-Za-z0-9]", "", _name)
    _plain = re.sub(r"[^a-z0-9.]+", " ", _name.lower())
    SENTENCES.setdefault(SPDX + _plain, _id)
    if _plain.endswith(" only"):
        SENTENCES.setdefault(SPDX + _plain[:-5], _id)  # the older spelling
    for _ref in _refs:
        SENTENCES.setdefault("licensed under " + _ref, _id)
        SENTENCES.setdefault("licensed under the " + _ref, _id)
    if _id in SENTENCES.values():
        RULES.append((_id, _name))
for _sentence, _id, _name in NOTICES:
    SENTENCES[_sentence] = _id
    if (_id, _name) not in RULES:
        RULES.append((_id, _name))

#: Spellings that stand for one known sentence, in normalised text.
VARIANTS = [
    (r"^neither the names? of .+ nor the names of (?:its|their|any|the) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^(?:this [a-z ]{1,40} (?:is|are) |it is |code )?(?:dual )?(?:licensed|released|distributed|made available|available) under (?:the terms of )?(?:the |an |a )?", "licensed under the "),
]

#: Every sentence holds one of these, so a text without any of them has no licence sentence.
TRIGGER = r"(?i)licen[sc]e|permission|permitted|redistribut|mozilla|mpl|merchantability|rights reserved|unencumbered|released under|distributed under|available under|spdx"
SHORTEST = min(len(s) for s in SENTENCES)
#: A licence is named: such a sentence that is not known is reported.
NAMED = r"(?i)licen[sc]ed? under|released under|spdx.license.identifier|public licen[sc]e|permission (?:is|to) .*grant|redistribut.* permitted"


def _clean(x: Column) -> Column:
    low = F.regexp_replace(F.lower(x), r"(?<=[0-9])\+", " or later")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9.]+", " "), r"(?<![0-9a-z])\.|\.(?![0-9a-z])", "")), " +", " "))


def sentences(text: Column) -> Column:
    """Sentences of a text that may be of a licence, in order, as written; line ends, and . ! ? before a blank or end, part them.

    A licence notice is often wrapped, so a line that begins in lower case, after
    an unfinished line, continues it. The dot of "v. 2.0" parts nothing.
    """
    joined = F.regexp_replace(text, r"(?<=[\w,])[ \t]*\r?\n[ \t*#/;-]*(?=[a-z(\"'])", " ")
    parts = F.split(joined, r"[\r\n]+|(?<!\b[vV])[.!?]+(?=\s|\z)|[.!?]+[\"')\]]+(?=\s|\z)")
    return F.filter(parts, lambda x: (F.length(x) >= SHORTEST) & x.rlike(TRIGGER))


def _identifiers(known: Column, part: Column) -> Column:
    """Identifiers of a sentence: known as a whole, as a variant, as an SPDX expression of several licences, or by its clauses."""

    def variant(x: Column) -> Column:
        for pattern, usual in VARIANTS:
            x = F.regexp_replace(x, pattern, usual)
        return x

    def look(x: Column) -> Column:
        return F.coalesce(F.element_at(known, x), F.element_at(known, variant(x)))

    def several(xs: Column) -> Column:
        return F.filter(F.transform(xs, look), lambda x: x.isNotNull())

    whole = _clean(part)
    terms = F.transform(F.split(F.regexp_extract(whole, "^" + SPDX + "(.+)$", 1), r" (?:and|or|with) (?!later)"), lambda x: F.concat(F.lit(SPDX), x))
    clauses = F.transform(F.split(part, "[;:]"), _clean)
    one = look(whole)
    return F.when(one.isNotNull(), F.array(one)).when(whole.startswith(SPDX), several(terms)).otherwise(several(clauses))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, sentence_ids (array), licenses (array, sorted and distinct), n_unmatched, unknown.

    Each sentence of the whole text is normalised and looked up among the known
    licence sentences, and where it is none of them, its clauses are; the identifiers in text order form a sequence, and the
    rules, in their order, consume the runs that they match. Identifiers that no
    rule consumes are counted as unmatched. Sentences that name a licence or grant
    but are not known, nor any clause of theirs, are listed in unknown as written. Null or empty texts, and texts with
    no licence sentence, give empty arrays. Rows are independent: no shuffle,
    and repeated ids are scanned alike. Other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(SENTENCES.items())])
    none = F.array().cast("array<string>")
    found = F.transform(sentences(F.col(text_col)), lambda s: F.struct(s.alias("s"), _identifiers(known, s).alias("ids")))
    scanned = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(TRIGGER), found).alias("__found"))
    unknown = F.transform(F.filter("__found", lambda x: (F.size(x["ids"]) == 0) & x["s"].rlike(NAMED)), lambda x: F.trim(x["s"]))
    scanned = scanned.select(F.col(id_col), F.coalesce(F.flatten(F.transform("__found", lambda x: x["ids"])), none).alias("sentence_ids"), F.coalesce(unknown, none).alias("unknown"))
    sequence = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    scanned = scanned.withColumn("__rest", F.when(F.size("sentence_ids") > 0, sequence).otherwise(F.lit("")))
    rules = F.array(*[F.struct(F.lit("|" + "||".join(ids.split()) + "|").alias("run"), F.lit(name).alias("name")) for ids, name in RULES])
    start = F.struct(F.col("__rest").alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        return F.struct(F.replace(state["rest"], rule["run"], F.lit("-")).alias("rest"), F.when(F.contains(state["rest"], rule["run"]), F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    scanned = scanned.withColumn("__out", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)).otherwise(start))
    left = F.regexp_count(F.col("__out.rest"), F.lit(r"\|[A-Za-z0-9]+\|"))
    return scanned.select(id_col, "sentence_ids", F.array_sort(F.array_distinct("__out.names")).alias("licenses"), left.alias("n_unmatched"), "unknown")
