"""Licence scans by sentence rules, in DataFrame functions only.

A text is normalised, the ends of its sentences and lines are marked, and a known licence
sentence becomes an identifier (with the version that it names).  It must begin where a
sentence or line does, after a standard lead-in at most; inside it line ends, punctuation and
comment signs are gaps, so wrapped and commented headers are met too.  The identifiers of a
text in order are then matched against ordered rules, each a sequence of identifiers that
stand side by side; a rule's match is consumed, so a longer rule wins over the shorter ones
that it contains.  Licences have their SPDX names, whether a tag or a sentence names them.

Only texts with one of a few licence words are normalised: every known sentence holds one of
them, so nothing is lost.  No shuffle, no Python on the executors.

Defined results: a null or empty text has no identifiers and no licences; very long texts
and repeated rows are taken row by row; an empty table gives an empty table; other columns
pass through, those named like a result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm._common import free_names, own_columns

#: A word of licence text: what every known sentence contains (a regular expression for Java and RE2).
HINT = r"(?i)licen[cs]e|copyright|permission|warrant|redistribut|public domain|liab|eupl|cc0|prohibited|advertising"

#: Parts of the patterns below.  A space is any gap (wrapped lines, punctuation and comment signs count as one), _ an optional one.
_VERSION = r"([0-9]+(?:\.[0-9]+)?)"
_V = r"(?:v(?:ersion)?_)?" + _VERSION
_LATER = r"or (?:at your option )?(?:any )?later"
_THING = r"works?|programs?|files?|software|projects?|library|modules?|packages?|code|scripts?|documents?|documentation|repository|product|materials?|sources?|contents?|data|dataset"
#: What may stand before a statement in its sentence: "this work is", "the contents of this file are", "(1)".
_LEAD = rf"(?:(?:this|the|these|all) (?:contents? of )?(?:this |the )?(?:source )?(?:{_THING}) (?:is|are) )?"
_UNDER = _LEAD + r"(?:also )?(?:released|licensed|distributed|published|made available|available|provided) under (?:the terms of )?"
_CC = _UNDER + r"(?:an? |the )?creative commons attribution"
_FREE = r"(?:[^\s|~<>]+\x20){1,12}?(?:is|are) free software you can redistribute (?:it|them) and or modify (?:it|them) under the terms (?:and conditions )?of "
_FSF = r" as published by the free software foundation"
_ITEM = r"(?:[0-9a-z] )?"

#: The families of the GNU licences.
_GNU = {"gpl": r"gnu general public license", "lgpl": r"gnu (?:lesser|library) general public license", "agpl": r"gnu affero general public license"}


def _gnu(name: str, words: str) -> dict[str, str]:
    return {
        f"{name}-later": rf"{_UNDER}the {words} {_V} {_LATER}",
        name: rf"{_UNDER}the {words} {_V}",
        f"{name}-free": rf"{_FREE}the {words}{_FSF}",
        f"{name}-only": rf"{_FREE}the {words} {_V}{_FSF}",
        f"{name}-of": rf"{_FREE}version {_VERSION} of the {words}{_FSF}",
    }


#: How known licence sentences begin (lower case, other characters as one space), by identifier.
#: A sentence may go on after its pattern.  A pattern's group, if it has one, is the version that follows the identifier.
SENTENCES: dict[str, str] = {
    "spdx": r"spdx license identifier ([a-z0-9.\s+\-]+)",
    "apache": rf"(?:{_UNDER}|the asf licenses this file to you under )the apache (?:software )?license {_V}",
    "apache-file": r"you may not use this file except in compliance with the license",
    "apache-copy": r"you may obtain a copy of the license at",
    "apache-asis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    **{k: v for name, words in _GNU.items() for k, v in _gnu(name, words).items()},
    "gpl-version": rf"(?:either )?version {_VERSION} of the license {_LATER} version",
    "gpl-exact": rf"(?:either )?version {_VERSION} of the license",
    "gpl-hope": rf"(?:this (?:{_THING})|[^\s|~<>]+) is distributed in the hope that it will be useful but without any warranty",
    "mit": rf"{_UNDER}(?:the |an )?mit(?: x11)? license",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software",
    "as-is": r"the software is provided as is without warranty of any kind",
    "liability": r"in no event shall the (?:[^\s|~<>]+ ){1,40}?be liable",
    "bsd": rf"{_UNDER}(?:the |an? )?([0-9]) clause bsd license",
    "bsd-new": rf"{_UNDER}(?:the |an? )?(?:new|modified|revised) bsd license",
    "bsd-simple": rf"{_UNDER}(?:the |an? )?(?:simplified|freebsd) (?:bsd )?license",
    "bsd-advert": rf"{_ITEM}all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
    "bsd-grant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": rf"{_ITEM}redistributions of source code must retain the above copyright notice",
    "bsd-binary": rf"{_ITEM}redistributions in binary form must reproduce the above copyright notice",
    "bsd-names": rf"{_ITEM}neither the names? of (?:[^\s|~<>]+ ){{1,40}}?may be used to endorse or promote products (?:[^\s|~<>]+ ){{1,20}}?written permission",
    "isc-grant": r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",
    "isc": rf"{_UNDER}the isc license",
    "postgres-grant": r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "zlib": rf"{_UNDER}the zlib(?: libpng)? license",
    "bsl-grant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "bsl": rf"(?:{_UNDER}|subject to )the boost software license",
    "epl": rf"{_UNDER}the eclipse public license {_V}",
    "cddl": rf"(?:the contents of this file are subject to the terms of|{_UNDER}) ?the common development and distribution license",
    "eupl": rf"{_UNDER}(?:the )?(?:eupl|european union public license) {_V}",
    "artistic": rf"{_UNDER}the artistic license {_V}",
    "psf": rf"{_UNDER}the python software foundation license",
    "ms-pl": rf"{_UNDER}the microsoft public license",
    "ofl": rf"{_UNDER}the sil open font license {_V}",
    "odbl": rf"{_UNDER}the (?:open data commons )?open database license",
    "wtfpl": rf"(?:{_UNDER})?(?:the )?do what the fuck you want to public license",
    "public-domain": rf"{_LEAD}(?:hereby )?(?:released|placed|dedicated) (?:in)?to the public domain",
    "cc0-waiver": r"to the extent possible under law (?:[^\s|~<>]+ ){1,30}?(?:has|have) waived all copyright and related or neighboring rights",
    "cc0": rf"{_UNDER}(?:the )?(?:creative commons )?cc0",
    "closed": r"unauthorized copying of this file via any medium is strictly prohibited",
    "mpl": rf"(?:this source code form is subject to the terms of the|the contents of this file are subject to the|{_UNDER}the) mozilla public license {_V}",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "cc-by-nc-nd": rf"{_UNDER}cc by nc nd {_VERSION}",
    "cc-by-nc-nd-name": rf"{_CC} non_commercial no_derivatives {_V}",
    "cc-by-nc-sa": rf"{_UNDER}cc by nc sa {_VERSION}",
    "cc-by-nc-sa-name": rf"{_CC} non_commercial share_alike {_V}",
    "cc-by-nd": rf"{_UNDER}cc by nd {_VERSION}",
    "cc-by-nd-name": rf"{_CC} no_derivatives {_V}",
    "cc-by-nc-name": rf"{_CC} non_commercial {_V}",
    "cc-by-sa-name": rf"{_CC} share_alike {_V}",
    "cc-by-name": rf"{_CC} {_V}",
    "cc-by-nc": rf"{_UNDER}cc by nc {_VERSION}",
    "cc-by-sa": rf"{_UNDER}cc by sa {_VERSION}",
    "cc-by": rf"{_UNDER}cc by {_VERSION}",
}


@dataclass(frozen=True)
class Rule:
    """A licence and the identifiers, in order, that stand for it; ``*`` in the name is the version."""

    licence: str
    sequence: tuple[str, ...]


#: Ordered rules; the first that matches takes its identifiers.
RULES: tuple[Rule, ...] = (
    Rule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is")),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("Apache-*", ("apache", "apache-file", "apache-copy", "apache-asis")),
    Rule("Apache-*", ("apache", "apache-file")),
    Rule("Apache-*", ("apache",)),
    *(Rule(f"{name.upper()}-*-or-later", (f"{name}-free", "gpl-version")) for name in _GNU),
    *(Rule(f"{name.upper()}-*-or-later", (f"{name}-later",)) for name in _GNU),
    *(Rule(f"{name.upper()}-*-only", (f"{name}-free", "gpl-exact")) for name in _GNU),
    *(Rule(f"{name.upper()}-*-only", (f"{name}{kind}",)) for kind in ("", "-only", "-of") for name in _GNU),
    Rule("MIT", ("mit",)),
    Rule("BSD-*-Clause", ("bsd",)),
    Rule("BSD-3-Clause", ("bsd-new",)),
    Rule("BSD-2-Clause", ("bsd-simple",)),
    Rule("ISC", ("isc-grant",)),
    Rule("ISC", ("isc",)),
    Rule("0BSD", ("0bsd-grant",)),
    Rule("PostgreSQL", ("postgres-grant",)),
    Rule("Zlib", ("zlib-grant",)),
    Rule("Zlib", ("zlib",)),
    Rule("BSL-1.0", ("bsl-grant",)),
    Rule("BSL-1.0", ("bsl",)),
    Rule("EPL-*", ("epl",)),
    Rule("CDDL-1.0", ("cddl",)),
    Rule("EUPL-*", ("eupl",)),
    Rule("Artistic-*", ("artistic",)),
    Rule("PSF-2.0", ("psf",)),
    Rule("MS-PL", ("ms-pl",)),
    Rule("OFL-*", ("ofl",)),
    Rule("ODbL-1.0", ("odbl",)),
    Rule("WTFPL", ("wtfpl",)),
    Rule("MPL-*", ("mpl",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("CC0-1.0", ("cc0-waiver",)),
    Rule("CC0-1.0", ("cc0",)),
    *(Rule(f"CC-BY{kind.upper()}-*", (f"cc-by{kind}{form}",)) for kind in ("-nc-nd", "-nc-sa", "-nd", "-nc", "-sa", "") for form in ("", "-name")),
    Rule("LicenseRef-Public-Domain", ("public-domain",)),
    Rule("LicenseRef-Closed", ("closed",)),
    Rule("SPDX:*", ("spdx",)),
)

#: SPDX names of licences that tags name and the rules do not; tags are met in lower case.
SPDX_NAMES = (
    *(rule.licence for rule in RULES if "*" not in rule.licence),
    *(f"{family}-{version}{kind}" for family, versions in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("1.0", "3.0"))) for version in versions for kind in ("", "-only", "-or-later")),
    *(f"CC-BY{kind}-{version}" for kind in ("", "-NC", "-ND", "-SA", "-NC-ND", "-NC-SA") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    "Apache-1.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-1-Clause", "CDDL-1.1", "CECILL-2.1", "Classpath-exception-2.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2",
    "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-RL", "NCSA", "OFL-1.1", "OpenSSL", "Ruby", "UPL-1.0", "Unicode-DFS-2016", "Vim", "W3C", "X11",
)


def _marked(text: Column) -> Column:
    """Normal form of a text: words, with | for the end of a sentence and ~ for a line's end that does not go on in lower case."""
    text = F.translate(text, "|~<>", "    ")
    # an SPDX tag ends with its line, a colon at a line's end starts a list
    text = F.regexp_replace(text, r"(?i)(SPDX-License-Identifier:[^\r\n]*)|:[ \t]*(?=\r?\n)", "$1 . ")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:dnl|DNL|rem|REM)[ \t]", "")
    text = F.regexp_replace(text, r"\n[ \t]*(?:(?://+|/?\*+|#+|;+|%+|--+)[ \t]*)?([a-z])", " $1")
    text = F.regexp_replace(F.regexp_replace(text, r"[.;!?]+(?=\s|$)", " | "), r"\n", " ~ ")
    text = F.regexp_replace(F.lower(text), r"(?<![0-9])\.|\.(?![0-9])", "")
    text = F.regexp_replace(F.concat(F.lit("| "), text, F.lit(" |")), r"[^a-z0-9.+|~]+", " ")
    return F.replace(text, F.lit("licence"), F.lit("license"))


def _whole(pattern: str) -> str:
    gaps = re.sub("[ _]", lambda m: r"(?: [|~])* " if m[0] == " " else r"(?:(?: [|~])* )?", pattern)
    return rf"(?<=[|~] )(?:{gaps})(?![a-z0-9.+])"


def _identifiers(text: Column) -> Column:
    """Identifiers "name@version" of the known sentences of a normal form, in order; a gap takes any line's or sentence's end."""
    for name, pattern in SENTENCES.items():
        text = F.regexp_replace(text, _whole(pattern), f"<{name}@{'$1' if '([' in pattern else ''}> |")
    return F.transform(F.regexp_extract_all(text, F.lit("<([^>]*)>"), F.lit(1)), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("-")))


def _sequence_pattern(rule: Rule) -> str:
    return "".join(f" +{x}@([^ ]*)" for x in rule.sequence) + "(?= )"


def _spdx(value: Column) -> Column:
    """SPDX names of the licences in a tag's expression (lower case, words joined by -)."""
    names = F.create_map(*[F.lit(x) for n in dict.fromkeys(SPDX_NAMES) for x in (n.lower(), n)])
    words = F.filter(F.split(value, r"-(?:or-(?!later(?:-|$))|and-|with-)"), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(F.element_at(names, w), w))


def _licenses(ids: Column) -> Column:
    """Names of the licences that the rules find in identifiers (joined by spaces), in the order of the text."""
    rest = F.concat(F.lit(" "), F.replace(ids, F.lit(" "), F.lit("  ")), F.lit(" "))
    for rule in RULES:
        head, star, tail = rule.licence.partition("*")
        group = next((i + 1 for i, x in enumerate(rule.sequence) if "([" in SENTENCES[x]), 0) if star else 0
        rest = F.regexp_replace(rest, _sequence_pattern(rule), f"  ={head}{f'${group}' if group else ''}{tail}=  ")
    found = F.regexp_extract_all(rest, F.lit("=([^=]*)="), F.lit(1))
    found = F.transform(found, lambda x: F.regexp_replace(x, r"^((?:A|L)?GPL-[0-9])-", "$1.0-"))
    return F.flatten(F.transform(found, lambda x: F.when(x.startswith("SPDX:"), _spdx(F.substring(x, 6, 1 << 30))).otherwise(F.array(x))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with sentence_ids and licenses (both joined by spaces, in the order of the text) and n_licenses.

    A licence found twice counts twice.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    likely = F.when(text.rlike(HINT), text).otherwise(F.lit(""))
    kept = [F.col(f"`{c}`") for c in own_columns(docs, ["sentence_ids", "licenses", "n_licenses"])]
    # named first, so that each step is worked out once
    (found,) = free_names(docs, "licenses")
    ids = docs.select(*kept, F.array_join(_identifiers(_marked(likely)), " ").alias("sentence_ids"))
    named = ids.select("*", F.when(F.col("sentence_ids") != "", _licenses(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")).alias(found))
    return named.select(*kept, "sentence_ids", F.array_join(found, " ").alias("licenses"), F.size(found).cast("long").alias("n_licenses"))
