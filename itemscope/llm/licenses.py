"""License scans by sentence rules.

A text is normalised (A-Z lower-cased, every run of other characters than
letters and digits one space), known licence sentences are mapped to their
identifiers where they stand, and the identifiers in order of their first
place are matched against ordered rules: a rule names the identifiers that must
follow each other; of a family the first rule that fits gives the licence.

Texts that bundle notices have more than that: ``every_sentence`` keeps all
places, ``every_licence`` the licences of all notices.  There the identifiers of
a rule must follow each other among those of its family, a place counts for one
notice, and earlier rules take theirs first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from itemscope.llm.common import text_bytes, with_arrow_columns

# Identifier and sentence (public licence texts and notices).
SENTENCES = {
    "apache2.notice": "Licensed under the Apache License, Version 2.0",
    "apache2.comply": "you may not use this file except in compliance with the License",
    "apache2.copy": "You may obtain a copy of the License at",
    "apache2.asis": "software distributed under the License is distributed on an \"AS IS\" BASIS",
    "apache2.see": "See the License for the specific language governing permissions and limitations under the License",
    "mit.notice": "Released under the MIT License",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit.include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "bsd.use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd.endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3.notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl.v3": "either version 3 of the License, or (at your option) any later version",
    "gpl.v2": "either version 2 of the License, or (at your option) any later version",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "ccbync4.notice": "Licensed under CC BY-NC 4.0",
    "ccby4.notice": "Licensed under CC BY 4.0",
    "ccby4.full": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl2.notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "spdx.apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx.mit": "SPDX-License-Identifier: MIT",
    "spdx.gpl3": "SPDX-License-Identifier: GPL-3.0",
    "reserved": "All rights reserved",
}
# Family, licence and the identifiers in order; earlier rules go first.
RULES = (
    ("apache", "Apache-2.0", ("apache2.notice", "apache2.comply")),
    ("apache", "Apache-2.0", ("apache2.notice",)),
    ("apache", "Apache-2.0", ("spdx.apache2",)),
    ("mit", "MIT", ("mit.grant", "mit.include")),
    ("mit", "MIT", ("mit.notice",)),
    ("mit", "MIT", ("spdx.mit",)),
    ("mit", "MIT-like", ("mit.grant",)),
    ("bsd", "BSD-3-Clause", ("bsd.use", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("bsd", "BSD-2-Clause", ("bsd.use", "bsd.source", "bsd.binary")),
    ("bsd", "BSD-like", ("bsd.use",)),
    ("gpl", "GPL-3.0-or-later", ("gpl.free", "gpl.v3")),
    ("gpl", "GPL-2.0-or-later", ("gpl.free", "gpl.v2")),
    ("gpl", "GPL-3.0", ("gpl3.notice",)),
    ("gpl", "GPL-3.0", ("spdx.gpl3",)),
    ("gpl", "GPL", ("gpl.free",)),
    ("cc", "CC-BY-NC-4.0", ("ccbync4.notice",)),
    ("cc", "CC-BY-4.0", ("ccby4.notice",)),
    ("cc", "CC-BY-4.0", ("ccby4.full",)),
    ("mpl", "MPL-2.0", ("mpl2.notice",)),
    ("proprietary", "all-rights-reserved", ("reserved",)),
)
_OTHER = re.compile(rb"[^a-z0-9]+")

NEW = [T.StructField("n_sentences", T.LongType()), T.StructField("sentences", T.StringType()),
       T.StructField("licenses", T.StringType()), T.StructField("every_sentence", T.StringType()),
       T.StructField("every_licence", T.StringType())]


def normalise(text: str) -> str:
    """Lower-cased ASCII letters and digits; every other run one space; a space at both ends."""
    return " " + _OTHER.sub(b" ", text.encode().lower()).decode().strip() + " "


def triggers(sentences: dict[str, str]) -> list[bytes]:
    """A few words of which every sentence holds one: only texts with one are normalised."""
    left, out = {k: set(normalise(s).split()) for k, s in sentences.items()}, []
    while left:
        every = sorted({w for ws in left.values() for w in ws}, key=lambda w: (-sum(w in x for x in left.values()), -len(w), w))
        word = next((w for w in every if len(w) >= 7), every[0])
        if not any(word in x for x in left.values()):
            break
        out.append(word.encode())
        left = {k: x for k, x in left.items() if word not in x}
    return out


def apply_rules(ids: list[str], rules) -> list[str]:
    """Licences of identifiers in order, one a family at most, in the order of the rules."""
    line, done, out = "," + ",".join(ids) + ",", set(), []
    for family, licence, needed in rules:
        if family not in done and "," + ",".join(needed) + "," in line:
            done.add(family)
            out.append(licence)
    return out


def places(plain: bytes, sentence: bytes) -> list[int]:
    """Every place of a normalised sentence; neighbours share the space between them."""
    out, p = [], plain.find(sentence)
    while p >= 0:
        out.append(p)
        p = plain.find(sentence, p + len(sentence) - 1)
    return out


def every_notice(ids: list[str], rules) -> list[str]:
    """Different licences of all notices among identifiers in order, by the place of their first notice."""
    own: dict[str, set[str]] = {}
    for family, _, needed in rules:
        own.setdefault(family, set()).update(needed)
    # identifiers that no rule names stand with the family their name starts with those of
    stem = {k.split(".")[0]: f for f, ks in own.items() for k in ks}
    line: dict[str, list[tuple[int, str]]] = {}
    for i, k in enumerate(ids):
        for family in [f for f in own if k in own[f]] or [stem.get(k.split(".")[0], "")]:
            line.setdefault(family, []).append((i, k))
    taken, found = set(), {}
    for family, licence, needed in rules:
        mine = line.get(family, [])
        for a in range(len(mine) - len(needed) + 1):
            some = mine[a:a + len(needed)]
            if tuple(k for _, k in some) == tuple(needed) and not any((family, i) in taken for i, _ in some):
                taken.update((family, i) for i, _ in some)
                found[licence] = min(found.get(licence, len(ids)), some[0][0])
    return sorted(found, key=found.get)


def _make(sentences: dict[str, str], rules):
    known = {k: normalise(s).encode() for k, s in sentences.items()}
    words = triggers(sentences)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        data, off = text_bytes(part.column("text"))
        n, ids, found, every, notices = [], [], [], [], []
        for i in range(len(off) - 1):
            raw = data[off[i]:off[i + 1]].tobytes().lower()
            at = []  # every place
            if any(w in raw for w in words):
                plain = b" " + _OTHER.sub(b" ", raw).strip() + b" "
                at = sorted((p, k) for k, s in known.items() for p in places(plain, s))
            whole = [k for _, k in at]
            names = list(dict.fromkeys(whole))
            n.append(len(names)), ids.append(",".join(names)), found.append(",".join(apply_rules(names, rules)))
            every.append(",".join(whole)), notices.append(",".join(every_notice(whole, rules)))
        return [pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in (ids, found, every, notices)]]
    return make


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """Every row of ``docs`` with ``(n_sentences, sentences, licenses, every_sentence, every_licence)``.

    ``sentences`` are the known sentences' identifiers in order of first place
    (same place: by identifier), ``licenses`` the rules' licences, one a family, as
    the query's SQL has them; ``every_sentence`` are the identifiers of all places,
    ``every_licence`` the different licences of all notices in order of place.  All
    are joined by commas; a null, empty or unlicensed text has 0 and empty strings.  Own
    columns with those names are dropped; an empty table gives an empty table.
    """
    return with_arrow_columns(docs, ["text"], _make(sentences or SENTENCES, rules), NEW)
