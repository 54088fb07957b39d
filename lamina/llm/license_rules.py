"""License detection: ordered signature rules behind a keyword prefilter, with suppression of contained detections.

A text becomes its words, lower-cased and joined by single spaces.  Each rule
is a regular expression over such a line, written by hand: licences by name in
four forms (a tag, a grant, a reference, a title) and passages of licence
texts.  One Aho-Corasick pass over a text finds which rules' keywords stand in
it; only those rules run.  Of the detections, one that lies inside another of
the same or a higher priority is dropped; of equal intervals the higher
priority stays, then the earlier rule.

Defined cases: null counts as empty; a text without words has no detection,
null positions, empty labels and score 0; very long texts are scanned whole;
rows are judged one by one, so ties and repeated rows give equal results;
other columns pass through, and result columns named like one replace it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licences by name: label, keywords (one must stand in the text), name as a pattern over words.
NAMES = (
    ("mit", "mit~|expat", "(?:mit|expat)(?: x11)?"),
    ("mit-0", "mit 0|mit no attribution", "mit (?:0|no attribution)"),
    ("apache-1", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?1(?: [01])?"),
    ("apache-2", "apache", "(?:apache|asl)(?: software)?(?: licen[sc]e)?(?: version| v)? ?v?2(?: 0)?"),
    ("bsd-0-clause", "0bsd|zero clause bsd|bsd zero clause", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("bsd-2-clause", "bsd", "(?:bsd 2(?: clause)?|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3(?: clause)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4(?: clause)?|(?:4|four) clause bsd|original bsd)"),
    ("bsd", "bsd~", "bsd(?: style)?"),
    ("isc", "isc~", "isc"),
    ("zlib", "zlib~", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng(?: 2 0)?"),
    ("boost-1", "boost|bsl 1", "(?:boost(?: software)?(?: license)?(?: version)?(?: 1(?: 0)?)?|bsl 1(?: 0)?)"),
    ("gpl-1", "gpl|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?v?1(?: 0)?"),
    ("gpl-2", "gpl|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?v?2(?: 0)?(?: only)?"),
    ("gpl-2-or-later", "gpl|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?v?2(?: 0)?(?: or(?: at your option)?(?: any)? later(?: version)?)"),
    ("gpl-3", "gpl|gplv3|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?v?3(?: 0)?(?: only)?"),
    ("gpl-3-or-later", "gpl|gplv3|general public", "(?:gnu )?(?:gpl|general public licen[sc]e)(?: version| v)? ?v?3(?: 0)?(?: or(?: at your option)?(?: any)? later(?: version)?)"),
    ("gpl", "gpl|general public", "(?:gnu gpl|gnu general public|gpl)"),
    ("lgpl-2", "lgpl|library general public", "(?:gnu )?(?:lgpl|library general public licen[sc]e)(?: version| v)? ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl|lesser general public", "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? ?v?2 1(?: or(?: any)? later)?"),
    ("lgpl-3", "lgpl|lgplv3|lesser general public", "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version| v)? ?v?3(?: 0)?(?: or(?: any)? later)?"),
    ("lgpl", "lgpl|lesser general public|library general public", "(?:gnu lgpl|(?:gnu )?(?:lesser|library) general public|lgpl)"),
    ("agpl-3", "agpl|agplv3|affero", "(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version| v)? ?v?3(?: 0)?(?: or(?: any)? later)?"),
    ("agpl", "agpl|affero", "(?:gnu agpl|(?:gnu )?affero general public|agpl)"),
    ("gfdl", "gfdl|free documentation", "(?:gnu )?(?:gfdl|free documentation)(?: license)?(?: version)?(?: 1 [123])?"),
    ("mpl-1", "mpl|mozilla", "(?:mpl|mozilla public licen[sc]e)(?: version| v)? ?1(?: [01])?"),
    ("mpl-2", "mpl|mozilla", "(?:mpl|mozilla public licen[sc]e)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "epl|eclipse public", "(?:epl|eclipse public licen[sc]e)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "epl|eclipse public", "(?:epl|eclipse public licen[sc]e)(?: version| v)? ?2(?: 0)?"),
    ("edl-1", "eclipse distribution", "eclipse distribution(?: license)?(?: version| v)?(?: 1 0)?"),
    ("cddl-1", "cddl|common development and distribution", "(?:cddl|common development and distribution licen[sc]e)(?: version| v)?(?: 1 [01])?"),
    ("cpl-1", "common public", "common public(?: license)?(?: version)?(?: 1 0)?"),
    ("ipl-1", "ibm public", "ibm public(?: license)?(?: version)?(?: 1 0)?"),
    ("eupl-1", "eupl|european union public", "(?:eupl|european union public licen[sc]e)(?: version| v)?(?: 1 [012])?"),
    ("cecill-2", "cecill", "cecill(?: free software)?(?: license)?(?: version)?(?: 2(?: [01])?)?"),
    ("cecill-b", "cecill b", "cecill b"),
    ("cecill-c", "cecill c", "cecill c"),
    ("artistic-1", "artistic", "artistic(?: license)?(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", "artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic", "artistic~", "artistic"),
    ("perl", "perl~", "perl(?: 5)?"),
    ("python-2", "python software foundation|psf", "(?:python software foundation|psf)(?: license)?(?: version)?(?: 2(?: 0)?)?"),
    ("ruby", "ruby~", "ruby"),
    ("php-3", "php", "php(?: license)?(?: version)?(?: 3(?: 01| 0)?)?"),
    ("openssl", "openssl~", "openssl"),
    ("postgresql", "postgresql~", "postgresql"),
    ("ncsa", "ncsa~|university of illinois ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl|do what the fuck", "(?:wtfpl|do what the fuck you want to public)"),
    ("beerware", "beerware|beer ware", "beer ?ware"),
    ("sil-ofl-1", "ofl|open font", "(?:sil )?(?:ofl|open font licen[sc]e)(?: version| v)?(?: 1 [01])?"),
    ("ms-pl", "ms pl|microsoft public", "(?:ms pl|microsoft public)"),
    ("ms-rl", "ms rl|microsoft reciprocal", "(?:ms rl|microsoft reciprocal)"),
    ("osl-3", "osl 3|open software license", "(?:osl|open software licen[sc]e)(?: version| v)? ?3(?: 0)?"),
    ("afl-3", "afl 3|academic free", "(?:afl|academic free licen[sc]e)(?: version| v)? ?3(?: 0)?"),
    ("upl-1", "universal permissive", "universal permissive(?: license)?(?: version| v)?(?: 1 0)?"),
    ("vim", "vim~", "vim"),
    ("x11", "x11~", "x11"),
    ("w3c", "w3c~|w3c software|w3c notice", "w3c(?: software)?(?: notice and)?"),
    ("unicode", "unicode", "unicode(?: inc)?"),
    ("curl", "curl~", "curl"),
    ("busl-1", "business source|busl", "(?:busl|business source licen[sc]e)(?: version| v)?(?: 1 1)?"),
    ("sspl-1", "sspl|server side public", "(?:sspl|server side public licen[sc]e)(?: version| v)?(?: 1(?: 0)?)?"),
    ("elastic-2", "elastic license", "elastic license(?: version| v)?(?: 2(?: 0)?)?"),
    ("mulan-psl-2", "mulan", "mulan(?: permissive software| psl)(?: license)?(?: version| v)?(?: 2(?: 0)?)?"),
    ("odbl-1", "odbl|open database", "(?:odbl|open database licen[sc]e)(?: version| v)?(?: 1(?: 0)?)?"),
    ("odc-by-1", "odc by|open data commons attribution", "(?:odc by|open data commons attribution)(?: 1 0)?"),
    ("pddl-1", "pddl|public domain dedication and license", "(?:pddl|(?:open data commons )?public domain dedication and licen[sc]e)(?: 1 0)?"),
    ("openrail", "openrail|rail m|responsible ai", "(?:open ?rail(?: m)?|responsible ai)"),
    ("cc0-1", "cc0|cc 0|cc zero", "(?:creative commons )?cc ?(?:0|zero)(?: 1(?: 0)?)?(?: universal)?"),
    ("cc-by", "cc by|creative commons attribution", "(?:cc by|creative commons attribution)(?: [1234] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", "cc by sa|attribution share", "(?:cc by sa|creative commons attribution share ?alike)(?: [1234] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", "cc by nc|attribution non", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?(?: international| unported| generic)?"),
    ("cc-by-nd", "cc by nd|attribution no", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-sa", "cc by nc sa|attribution non", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-nd", "cc by nc nd|attribution non", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international| unported| generic)?"),
    ("cc", "creative commons", "creative commons"),
)

#: Forms a name comes in: the pattern around it, priority, confidence.
FORMS = (
    ("spdx license identifiers? (?:%s)", 9, 1.0),
    ("(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|covered|shared|free software)(?: [^ ]+){0,3}? under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:%s)(?: licen[sc]e)?", 7, 0.95),
    ("licen[sc]e (?:is |the )?(?:%s)(?: licen[sc]e)?", 6, 0.8),
    ("(?:%s)(?: public)? licen[sc]e", 5, 0.7),
)
#: Longer names lie over shorter ones; a name that says a version goes before one that does not.
FAMILIES = {"bsd", "gpl", "lgpl", "agpl", "artistic", "cc"}

#: Passages of licence texts and other notices: label, keyword, pattern, priority, confidence.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 8, 0.98),
    ("mit", "shall be included in all copies or substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 8, 0.9),
    ("isc", "permission to use copy modify and", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 8, 0.95),
    ("bsd", "redistribution and use in source and binary", "redistribution and use in source and binary forms with or without modification are permitted", 8, 0.9),
    ("bsd-3-clause", "to endorse or promote products", "neither the names? of [^.]{1,80}? may be used to endorse or promote products", 8, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display", 8, 0.95),
    ("apache-2", "you may not use this file except in compliance", "you may not use this file except in compliance with the license", 8, 0.9),
    ("apache-2", "apache org licenses license 2", "apache org licenses license 2(?: 0)?", 8, 0.95),
    ("zlib", "in no event will the authors be held liable", "provided as is without any express or implied warranty in no event will the authors be held liable", 8, 0.9),
    ("boost-1", "boost org license", "boost org license 1 0(?: txt)?", 8, 0.95),
    ("gpl", "under the terms of the gnu general public", "redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?", 8, 0.95),
    ("lgpl", "under the terms of the gnu lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license(?: as published by the free software foundation)?", 8, 0.95),
    ("lgpl", "under the terms of the gnu library", "redistribute it and or modify it under the terms of the gnu library general public license(?: as published by the free software foundation)?", 8, 0.95),
    ("agpl", "under the terms of the gnu affero", "redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?", 8, 0.95),
    ("gpl", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl", 7, 0.8),
    ("lgpl", "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl", 7, 0.8),
    ("agpl", "gnu org licenses", "gnu org licenses agpl", 7, 0.8),
    ("mpl-2", "subject to the terms of the mozilla", "subject to the terms of the mozilla public license v(?:ersion)? ?2 0", 8, 0.95),
    ("mpl-2", "mozilla org mpl", "mozilla org mpl(?: 2 0)?", 7, 0.9),
    ("epl-2", "eclipse org legal epl", "eclipse org legal epl(?: v| )?20?", 7, 0.9),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 8, 0.98),
    ("wtfpl", "you just do what", "you just do what the fuck you want to", 8, 0.95),
    ("beerware", "buy me a beer", "you can buy me a beer in return", 8, 0.9),
    ("sil-ofl-1", "scripts sil org ofl", "scripts sil org ofl", 7, 0.9),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put)(?: [^ ]+){0,3}? (?:in|into|to) the public domain", 6, 0.8),
    ("public-domain", "public domain", "(?:is|are) in the public domain", 5, 0.6),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1234] [05]", 8, 0.95),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1234] [05]", 8, 0.95),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1234] [05]", 8, 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1234] [05]", 8, 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1234] [05]", 8, 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1234] [05]", 8, 0.95),
    ("cc0-1", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0", 8, 0.95),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 3, 0.5),
    ("all-rights-reserved", "alle rechte vorbehalten", "alle rechte vorbehalten", 3, 0.5),
    ("all-rights-reserved", "tous droits réservés", "tous droits réservés", 3, 0.5),
    ("all-rights-reserved", "todos los derechos reservados", "todos los derechos reservados", 3, 0.5),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 4, 0.7),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|software|document)(?: [^ ]+){0,6}? is strictly prohibited", 6, 0.8),
)


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    confidence: float


class Found(NamedTuple):
    """A detection: words ``first`` to ``last``, counted from 0."""

    first: int
    last: int
    priority: int
    order: int
    label: str
    confidence: float


def _keywords(spec: str) -> tuple[str, ...]:
    """Keywords of a licence; one with ``~`` is an everyday word and counts only beside a word on licences."""
    out: list[str] = []
    for k in spec.split("|"):
        if k.endswith("~"):
            k = k[:-1]
            out += [f"{k} license", f"{k} licence", f"{k} style", f"{k} x11", f"{k} libpng", f"{k} software", f"{k} public", f"under {k}", f"under the {k}", f"of the {k}", f"of {k}", f"identifier {k}", f"identifiers {k}"]
            out += [f"{w} {joint}{k}" for w in ("license", "licence") for joint in ("", "is ", "the ")]
        else:
            out.append(k)
    return tuple(out)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules in their order: the base phrases, passages, then each licence in each form."""
    out = [Rule(label, (phrase,), phrase, 10, 1.0) for phrase, label in BASE.items()]
    out += [Rule(label, (key,), pattern, priority, sure) for label, key, pattern, priority, sure in PASSAGES]
    for form, priority, sure in FORMS:
        for label, keys, name in NAMES:
            out.append(Rule(label, _keywords(keys), form % name, priority - (label in FAMILIES), sure))
    return tuple(out)


@lru_cache(maxsize=None)
def _compiled(k: int) -> re.Pattern:
    return re.compile(f"(?<![^ ])(?:{rules()[k].pattern})(?![^ ])")


@lru_cache(maxsize=1)
def _prefilter() -> ahocorasick.Automaton:
    """Rules by keyword; keywords stand at the start of a word, and may end inside one."""
    by_key: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()):
        for key in rule.keywords:
            by_key.setdefault(f" {key}", []).append(k)
    automaton = ahocorasick.Automaton()
    for key, which in by_key.items():
        automaton.add_word(key, tuple(which))
    automaton.make_automaton()
    return automaton


#: A-Z in lower case; everything else below 128 but letters and digits as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def places(line: str, which: list[int]) -> list[Found]:
    """All detections of the rules ``which`` in a line of words."""
    spans = [(m.start(), m.end(), k) for k in which for m in _compiled(k).finditer(line)]
    out, at, word = [], 0, 0
    for begin, end, k in sorted(spans):
        word, at = word + line.count(" ", at, begin), begin
        rule = rules()[k]
        out.append(Found(word, word + line.count(" ", begin, end), rule.priority, k, rule.label, rule.confidence))
    return out


def unsuppressed(found: list[Found]) -> list[Found]:
    """Detections that lie in none of the same or a higher priority, in the order of their places.

    From the highest priority on, longer ones first: what is kept so far is
    held as intervals of which none contains another, so one lookup tells
    whether a kept one contains the next.
    """
    kept: list[Found] = []
    for level in sorted({f.priority for f in found}, reverse=True):
        mine = sorted((f for f in found if f.priority == level), key=lambda f: (f.first, -f.last, f.order))
        over = sorted(kept, key=lambda f: f.first)
        reach, at = -1, 0
        for f in mine:
            while at < len(over) and over[at].first <= f.first:
                reach, at = max(reach, over[at].last), at + 1
            if f.last > reach:
                kept.append(f)
                reach = f.last
    return sorted(kept)


def detect(line: str) -> list[Found]:
    """Detections in a line of words after suppression."""
    which = {k for _, ks in _prefilter().iter(f" {line} ") for k in ks}
    return unsuppressed(places(line, sorted(which))) if which else []


_N_BASE = len(BASE)
_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
COLUMNS = [f.split()[0] for f in _FIELDS.split(", ")]
_SPANS = "array<struct<label: string, first_word: long, last_word: long, priority: int, confidence: double>>"


def _judged(text: str | None) -> tuple:
    words = folded(text)
    line = b" ".join(words).decode("utf-8", "surrogatepass")
    found = detect(line)
    base = [f for f in found if f.order < _N_BASE]
    labels = sorted({f.label for f in found})
    starts = [f.first for f in base]
    score = max((f.confidence for f in found), default=0.0)
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({f.label for f in base})), ",".join(labels), score


def verdict(text: Column) -> Column:
    """Counts, base places, labels and score (the highest confidence of a detection) of each text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([_judged(t) for t in texts], columns=COLUMNS)
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return F.pandas_udf(run, _FIELDS)(text)


def spans(text: Column) -> Column:
    """The unsuppressed detections of each text with their words' numbers."""

    def run(texts: pd.Series) -> pd.Series:
        found = (detect(b" ".join(folded(t)).decode("utf-8", "surrogatepass")) for t in texts)
        return pd.Series([[(f.label, f.first, f.last, f.priority, f.confidence) for f in fs] for fs in found], dtype="object")

    return F.pandas_udf(run, _SPANS)(text)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns ``COLUMNS`` for each row; no shuffle."""
    judged = df.select(*[F.col(c) for c in df.columns if c.lower() not in COLUMNS], verdict(F.col(text)).alias("_verdict"))
    return judged.select(*[c for c in judged.columns if c != "_verdict"], "_verdict.*")
