"""License scans by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over the text with its words lower-cased and joined by one blank. Each rule
has keywords that gate it, a priority and a confidence. A text without any keyword is not even split; a rule
runs only where its keywords stand. A detection inside another's interval is suppressed if that one has the
higher priority, or the same priority and more words, or the same words and the earlier rule.
Everything is row-local: no shuffle, and a text of any length is one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import bind

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of the text as it is; upper case folds later
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases whose places are counted, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Labels of known licences, patterns of the names they go by (words, lower case), and words
# of which every match of the pattern holds one.
NAMES = (
    ("mit", "mit|expat|x11", "mit expat x11"),
    ("apache", "apache", "apache"),
    ("gpl", "gpl|gnu general public|general public", "gpl general"),
    ("lgpl", "lgpl|(gnu )?(lesser|library) general public", "lgpl general"),
    ("agpl", "agpl|(gnu )?affero general public", "agpl affero"),
    ("bsd", "bsd|berkeley software distribution", "bsd berkeley"),
    ("bsd-2-clause", "simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd", "bsd freebsd"),
    ("bsd-3-clause", "new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd", "bsd"),
    ("bsd-4-clause", "original bsd|bsd 4 clause|4 clause bsd|four clause bsd", "bsd"),
    ("isc", "isc|internet systems consortium", "isc consortium"),
    ("mpl", "mpl|mozilla public", "mpl mozilla"),
    ("epl", "epl|eclipse public", "epl eclipse"),
    ("cddl", "cddl|common development and distribution", "cddl common"),
    ("cpl", "common public", "common"),
    ("eupl", "eupl|european union public", "eupl european"),
    ("artistic", "artistic|perl artistic", "artistic"),
    ("zlib", "zlib( libpng)?", "zlib"),
    ("boost", "boost( software)?", "boost"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl fuck"),
    ("cc0", "cc0|creative commons zero", "cc0 creative"),
    ("cc-by", "cc by|creative commons attribution", "cc creative"),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", "cc creative"),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", "cc creative"),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(ative)?s", "cc creative"),
    ("ofl", "ofl|(sil )?open font", "ofl font"),
    ("python", "python software foundation|psf", "python psf"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("ms-pl", "ms pl|microsoft public", "ms microsoft"),
    ("odbl", "odbl|open data commons open database|open database", "odbl database"),
    ("sspl", "server side public|sspl", "server sspl"),
    ("public-domain", "public domain", "domain"),
)

# Forms that a name takes in a text; {} is the name. Words of which every match holds one,
# pattern, priority, confidence.
FORMS = (
    ("licenses licences", "({}) licen[cs]es", 1, 0.6),
    ("license licence", "licen[cs]e (is |type )?(the )?({})", 2, 0.8),
    ("license licence", "(the )?({}) licen[cs]e", 3, 0.9),
    ("license licence", "(the )?({}) licen[cs]e (version |v )?[0-9]+( [0-9]+)?", 4, 0.95),
    (
        "released licensed distributed available published provided covered",
        "(released|licensed|distributed|available|published|provided|covered) (under|by|subject to) (the )?(terms of )?(the )?({})( licen[cs]e)?",
        5, 1.0,
    ),
    ("spdx", "spdx licen[cs]e identifier ({})", 6, 1.0),
)

# Signatures of licence versions, each written for itself. Label, words of which every match holds
# one, pattern. A version stands behind the licence's name, its short name or its SPDX identifier.
VERSIONS = (
    ("apache-1.0", "apache", "(the )?apache (software )?licen[cs]e (version |v ?)1 0"),
    ("apache-1.1", "apache", "(the )?apache (software )?licen[cs]e (version |v ?)?1 1"),
    ("apache-1.1", "apache", "apache (v ?)?1 1"),
    ("apache-2.0", "apache", "(the )?apache (software )?licen[cs]e (version |v ?)?2( 0)?"),
    ("apache-2.0", "apache", "apache (v ?)?2( 0)?( licen[cs]ed?)?"),
    ("apache-2.0", "asl", "asl (version |v ?)?2( 0)?"),
    ("gpl-1.0", "general", "(gnu )?general public licen[cs]e (version |v ?)1( 0)?"),
    ("gpl-2.0", "general", "(the )?(gnu )?general public licen[cs]e (as published by the free software foundation (either )?)?(version |v ?)2( 0)?"),
    ("gpl-2.0", "gpl gplv2 gpl2", "(gnu )?(gpl (version |v ?)?2( 0)?|gplv2|gpl2)"),
    ("gpl-2.0-only", "general", "(gnu )?general public licen[cs]e (version |v ?)2( 0)? only"),
    ("gpl-2.0-only", "gpl gplv2", "(gpl (version |v ?)?2( 0)?|gplv2) only"),
    ("gpl-2.0-or-later", "general", "(gnu )?general public licen[cs]e (version |v ?)2( 0)? or (at your option )?(any )?later( version)?"),
    ("gpl-2.0-or-later", "gpl gplv2", "(gpl (version |v ?)?2( 0)?|gplv2) or (at your option )?(any )?later( version)?"),
    ("gpl-2.0-or-later", "either", "either version 2 of the licen[cs]e or (at your option )?any later version"),
    ("gpl-3.0", "general", "(the )?(gnu )?general public licen[cs]e (as published by the free software foundation (either )?)?(version |v ?)3( 0)?"),
    ("gpl-3.0", "gpl gplv3 gpl3", "(gnu )?(gpl (version |v ?)?3( 0)?|gplv3|gpl3)"),
    ("gpl-3.0-only", "general", "(gnu )?general public licen[cs]e (version |v ?)3( 0)? only"),
    ("gpl-3.0-only", "gpl gplv3", "(gpl (version |v ?)?3( 0)?|gplv3) only"),
    ("gpl-3.0-or-later", "general", "(gnu )?general public licen[cs]e (version |v ?)3( 0)? or (at your option )?(any )?later( version)?"),
    ("gpl-3.0-or-later", "gpl gplv3", "(gpl (version |v ?)?3( 0)?|gplv3) or (at your option )?(any )?later( version)?"),
    ("gpl-3.0-or-later", "either", "either version 3 of the licen[cs]e or (at your option )?any later version"),
    ("lgpl-2.0", "library", "(gnu )?library general public licen[cs]e (version |v ?)2( 0)?"),
    ("lgpl-2.0", "lgpl", "lgpl (version |v ?)?2 0"),
    ("lgpl-2.1", "lesser", "(the )?(gnu )?lesser general public licen[cs]e (version |v ?)?2 1"),
    ("lgpl-2.1", "lgpl lgplv2", "(gnu )?(lgpl (version |v ?)?2 1|lgplv2 1)"),
    ("lgpl-2.1-or-later", "lesser", "(gnu )?lesser general public licen[cs]e (version |v ?)?2 1 or (at your option )?(any )?later( version)?"),
    ("lgpl-2.1-or-later", "lgpl lgplv2", "(lgpl (version |v ?)?2 1|lgplv2 1) or (at your option )?(any )?later( version)?"),
    ("lgpl-3.0", "lesser", "(the )?(gnu )?lesser general public licen[cs]e (version |v ?)?3( 0)?"),
    ("lgpl-3.0", "lgpl lgplv3", "(gnu )?(lgpl (version |v ?)?3( 0)?|lgplv3)"),
    ("lgpl-3.0-or-later", "lesser", "(gnu )?lesser general public licen[cs]e (version |v ?)?3( 0)? or (at your option )?(any )?later( version)?"),
    ("agpl-3.0", "affero", "(the )?(gnu )?affero general public licen[cs]e (version |v ?)?3( 0)?"),
    ("agpl-3.0", "agpl agplv3", "(gnu )?(agpl (version |v ?)?3( 0)?|agplv3)"),
    ("agpl-3.0-or-later", "affero", "(gnu )?affero general public licen[cs]e (version |v ?)?3( 0)? or (at your option )?(any )?later( version)?"),
    ("agpl-3.0-or-later", "agpl agplv3", "(agpl (version |v ?)?3( 0)?|agplv3) or (at your option )?(any )?later( version)?"),
    ("gfdl-1.1", "documentation", "(gnu )?free documentation licen[cs]e (version |v ?)?1 1"),
    ("gfdl-1.2", "documentation", "(gnu )?free documentation licen[cs]e (version |v ?)?1 2"),
    ("gfdl-1.3", "documentation", "(gnu )?free documentation licen[cs]e (version |v ?)?1 3"),
    ("gfdl", "documentation", "(gnu )?free documentation licen[cs]e"),
    ("gfdl", "gfdl", "gfdl( 1 [123])?"),
    ("mpl-1.0", "mozilla", "mozilla public licen[cs]e (version |v ?)?1 0"),
    ("mpl-1.1", "mozilla", "(the )?mozilla public licen[cs]e (version |v ?)?1 1"),
    ("mpl-1.1", "mpl", "mpl (version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", "(the )?mozilla public licen[cs]e (version |v ?)?2( 0)?"),
    ("mpl-2.0", "mpl", "mpl (version |v ?)?2( 0)?"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e (version |v ?)?1( 0)?"),
    ("epl-1.0", "epl", "epl (version |v ?)?1 0"),
    ("epl-2.0", "eclipse", "(the )?eclipse public licen[cs]e (version |v ?)?2( 0)?"),
    ("epl-2.0", "epl", "epl (version |v ?)?2( 0)?"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e (version |v ?)?1 0"),
    ("cddl-1.0", "common", "common development and distribution licen[cs]e (cddl )?(version |v ?)?1 0"),
    ("cddl-1.0", "cddl", "cddl (version |v ?)?1 0"),
    ("cddl-1.1", "common", "common development and distribution licen[cs]e (cddl )?(version |v ?)?1 1"),
    ("cddl-1.1", "cddl", "cddl (version |v ?)?1 1"),
    ("cpl-1.0", "common", "common public licen[cs]e (version |v ?)?1 0"),
    ("ipl-1.0", "ibm", "ibm public licen[cs]e( (version |v ?)?1 0)?"),
    ("eupl-1.1", "european", "european union public licen[cs]e (version |v ?)?1 1"),
    ("eupl-1.1", "eupl", "eupl (version |v ?)?1 1"),
    ("eupl-1.2", "european", "european union public licen[cs]e (version |v ?)?1 2"),
    ("eupl-1.2", "eupl", "eupl (version |v ?)?1 2"),
    ("artistic-1.0", "artistic", "(the )?artistic licen[cs]e (version |v ?)?1 0"),
    ("artistic-2.0", "artistic", "(the )?artistic licen[cs]e (version |v ?)?2( 0)?"),
    ("artistic-2.0", "artistic", "artistic 2( 0)?"),
    ("boost-1.0", "boost", "(the )?boost software licen[cs]e (version |v ?)?1 0"),
    ("boost-1.0", "bsl", "bsl 1 0"),
    ("busl-1.1", "business", "business source licen[cs]e( (version |v ?)?1 1)?"),
    ("busl-1.1", "busl", "busl 1 1"),
    ("cc0-1.0", "cc0", "cc0 (version |v ?)?1 0( universal)?"),
    ("cc0-1.0", "creative", "creative commons (cc0|zero)( (version |v ?)?1 0)? universal( public domain dedication)?"),
    ("cc-by-2.0", "creative", "creative commons attribution 2 0( generic)?( licen[cs]e)?"),
    ("cc-by-2.5", "creative", "creative commons attribution 2 5( generic)?( licen[cs]e)?"),
    ("cc-by-3.0", "creative", "creative commons attribution 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-3.0", "cc", "cc by 3 0"),
    ("cc-by-4.0", "creative", "creative commons attribution 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-4.0", "cc", "cc by 4 0"),
    ("cc-by-sa-2.0", "cc", "cc by sa 2 0"),
    ("cc-by-sa-3.0", "creative", "creative commons attribution share ?alike 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "creative", "creative commons attribution share ?alike 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "creative", "creative commons attribution non ?commercial 3 0( unported)?( licen[cs]e)?"),
    ("cc-by-nc-4.0", "creative", "creative commons attribution non ?commercial 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0"),
    ("cc-by-nc-sa-3.0", "cc", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "creative", "creative commons attribution non ?commercial share ?alike 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative", "creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0"),
    ("cc-by-nd-4.0", "creative", "creative commons attribution no ?deriv(ative)?s 4 0( international)?( public)?( licen[cs]e)?"),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0"),
    ("ofl-1.0", "font", "(sil )?open font licen[cs]e (version |v ?)?1 0"),
    ("ofl-1.1", "font", "(the )?(sil )?open font licen[cs]e (version |v ?)?1 1"),
    ("ofl-1.1", "ofl", "ofl (version |v ?)?1 1"),
    ("odbl-1.0", "database", "open (data commons open )?database licen[cs]e( odbl)? (version |v ?)?1 0"),
    ("odbl-1.0", "odbl", "odbl (version |v ?)?1 0"),
    ("odc-by-1.0", "commons", "open data commons attribution licen[cs]e( (version |v ?)?1 0)?"),
    ("pddl-1.0", "pddl", "pddl( (version |v ?)?1 0)?"),
    ("pddl-1.0", "commons", "open data commons public domain dedication and licen[cs]e"),
    ("osl-3.0", "open", "open software licen[cs]e (version |v ?)?3 0"),
    ("osl-3.0", "osl", "osl (version |v ?)?3 0"),
    ("afl-3.0", "academic", "academic free licen[cs]e (version |v ?)?3 0"),
    ("afl-3.0", "afl", "afl (version |v ?)?3 0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e( ms rl)?"),
    ("python-2.0", "python", "python (software foundation )?licen[cs]e (version |v ?)?2( 0)?"),
    ("php-3.01", "php", "php licen[cs]e (version |v ?)?3 01"),
    ("php", "php", "php licen[cs]e"),
    ("zpl-2.1", "zope", "zope public licen[cs]e( zpl)? (version |v ?)?2 1"),
    ("zpl", "zope", "zope public licen[cs]e"),
    ("ncsa", "illinois", "university of illinois ncsa( open source)?( licen[cs]e)?"),
    ("ecl-2.0", "educational", "educational community licen[cs]e (version |v ?)?2( 0)?"),
    ("lppl-1.3c", "latex", "latex project public licen[cs]e( (version |v ?)?1 3c?)?"),
    ("qpl-1.0", "qpl", "q public licen[cs]e( (version |v ?)?1 0)?|qpl 1 0"),
    ("nposl-3.0", "profit", "non profit open software licen[cs]e( (version |v ?)?3 0)?"),
    ("openrail-m", "openrail", "(creativeml |bigscience )?openrail( m)?( licen[cs]e)?"),
    ("llama-2", "llama", "llama 2 community licen[cs]e( agreement)?"),
    ("llama-3", "llama", "(meta )?llama 3 community licen[cs]e( agreement)?"),
    ("mulan-2.0", "mulan", "mulan (permissive software licen[cs]e|psl) (version |v ?)?2( 0)?|mulanpsl 2 0"),
    ("cecill-2.1", "cecill", "cecill (free software licen[cs]e agreement )?(version |v ?)?2 1"),
    ("cecill-b", "cecill", "cecill b"),
    ("cecill-c", "cecill", "cecill c"),
    ("ogl-3.0", "government", "open government licen[cs]e (version |v ?)?3 0"),
    ("ogl", "government", "open government licen[cs]e"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "zero", "zero clause bsd licen[cs]e"),
    ("mit-0", "mit", "mit no attribution licen[cs]e|mit 0"),
    ("bsd-2-clause-patent", "bsd", "bsd 2 clause (plus )?patent( licen[cs]e)?"),
    ("bsd-3-clause-clear", "clear", "clear bsd licen[cs]e|bsd 3 clause clear( licen[cs]e)?"),
    ("upl-1.0", "universal", "universal permissive licen[cs]e( upl)?( (version |v ?)?1 0)?"),
    ("blueoak-1.0.0", "oak", "blue oak model licen[cs]e( (version |v ?)?1 0 0)?|blueoak 1 0 0"),
    ("vim", "vim", "vim licen[cs]e"),
    ("beerware", "beer", "beer ?ware licen[cs]e|the beer ware licen[cs]e revision 42"),
    ("ruby", "ruby", "ruby licen[cs]e|ruby s licen[cs]e"),
    ("json", "json", "json licen[cs]e"),
)

# Sentences of licence texts and notices. Label, words of which every match holds one, pattern.
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy( of this software and associated documentation files)?"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at http www apache org licenses license 2 0"),
    ("apache-2.0", "apache", "http(s)? www apache org licenses license 2 0"),
    ("apache", "compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", "foundation", "as published by the free software foundation"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "received", "you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", "copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", "distributed", "if a copy of the mpl was not distributed with this file"),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0"),
    ("unlicense", "unencumbered", "(this is )?free and unencumbered software released into the public domain"),
    ("public-domain", "dedicated", "dedicated to the public domain"),
    ("public-domain", "hereby", "hereby (released|placed) (into|in) the public domain"),
    ("cc0", "waive", "waive all of (his|her|their) rights to the work"),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("boost", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("ofl", "reserved", "with reserved font name"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "unauthorized", "unauthorized (copying|use|reproduction) of this (file|software|document)"),
    ("non-commercial", "commercial", "for non commercial (use|purposes) only"),
    ("copyright", "copyright", "copyright (c )?[0-9]{4}"),
)
VERSION_PRIORITY, VERSION_CONFIDENCE = 7, 0.95
SENTENCE_PRIORITY, SENTENCE_CONFIDENCE = 8, 0.9


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    forms: tuple[str, ...]  # one of these words must stand in the text,
    names: tuple[str, ...]  # and one of these
    pattern: str  # of a folded text
    priority: int
    confidence: float


def _spaced(pattern: str) -> str:
    """The pattern for a folded text, where every word has a blank of its own on either side."""
    return f" ({pattern.replace(' ?', '( )?').replace(' ', '  ')}) "


def _named(pattern: str) -> bool:
    """Whether every match of a pattern holds the word licence."""
    bare, last = pattern, ""
    while bare != last:
        bare, last = re.sub(r"\([^()]*\)\?", "", bare), bare
    return all(re.search(r"licen\[cs\]e", part) for part in re.split(r"\|(?![^()]*\))", bare))


# What stands before the number of a version that needs no word licence. It keeps texts from being split into words.
SHORT = (
    r"(?:gpl|gplv|mpl|epl|cddl|eupl|bsl|busl|cc0|ofl|odbl|pddl|osl|afl|qpl|asl|apache|artistic|bsd|mit|by|sa|nc|nd|attribution|commercial|alike"
    r"|deriv\w{0,6}|oak|psl|psl2?|llama|cecill|\(?c\)?)[^a-z0-9]{0,3}(?:v|version[^a-z0-9])?[^a-z0-9]{0,2}[0-9]|0bsd"
)
LONG = ("openrail", "cecill", "illinois", "gfdl", "pddl", "universal")


def rules() -> list[Rule]:
    """All signature rules in order: every form of every name, then the signatures of versions and the sentences."""
    out = [
        (label, forms, names, form.format(name), priority, confidence)
        for forms, form, priority, confidence in FORMS
        for label, name, names in NAMES
    ]
    licence = "license licence"
    out += [(label, licence if _named(p) else words, words, p, VERSION_PRIORITY, VERSION_CONFIDENCE) for label, words, p in VERSIONS]
    out += [(label, words, words, pattern, SENTENCE_PRIORITY, SENTENCE_CONFIDENCE) for label, words, pattern in SENTENCES]
    return [
        Rule(i, label, tuple(forms.split()), tuple(names.split()), _spaced(pattern), priority, confidence)
        for i, (label, forms, names, pattern, priority, confidence) in enumerate(out)
    ]


def folded(text: Column) -> Column:
    """The words of a text in lower case, each with a blank before it and its number and a blank after it."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i)), "  "), F.lit(" "))


def _numbered(pattern: str) -> str:
    """The pattern for a text of :func:`folded`: a number follows every word, so a match tells where it stands."""
    return pattern[:-1].replace("  ", NUMBER + "  ") + NUMBER + " "


NUMBER = "#[0-9]+"


def scanned(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``detections``.

    ``base`` lists (label, first) of every place of a base phrase; ``detections`` lists what rules found and
    suppression left: (rule, label, first, words, priority, confidence). Words count from 0. Both are empty
    arrays where nothing is found. A null text is an empty one. Columns of ``docs`` with these names are replaced.
    """
    found = rules() if found is None else found
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short = {r.number for r in found if r.priority == VERSION_PRIORITY and r.forms != ("license", "licence")}
    words = sorted({w for r in found if r.number not in short for w in r.forms} | {phrase.split()[-1] for phrase, _ in BASE} | set(LONG))
    gate = bind(F.lower(raw), lambda t: reduce(or_, (t.contains(w) for w in words)) | (t.rlike("[0-9]") & t.rlike(SHORT)))
    # Only texts that hold a keyword are folded and split into words.
    text = F.col("__folded")
    return (
        docs.withColumn("n_words", F.regexp_count(raw, F.lit(WORD)).cast("bigint"))
        .withColumn("__folded", F.when(gate, folded(raw)))
        .withColumn("base", F.coalesce(_base(text), F.array().cast("array<struct<label:string,first:bigint>>")))
        .withColumn("detections", F.coalesce(_detections(text, found), F.array().cast(_FOUND)))
        .drop("__folded")
    )


_SORTED = "array<struct<first:bigint,shorter:bigint,lower:int,rule:int,label:string,confidence:double>>"
FOLD = 256  # detections that one fold appends
_FOUND = "array<struct<rule:int,label:string,first:bigint,words:bigint,priority:int,confidence:double>>"


def _spans(text: Column, pattern: Column) -> Column:
    """(first, words) of every match in a folded text, each read from the match alone."""
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hit: F.named_struct(
        F.lit("first"), F.regexp_extract(hit, "#([0-9]+)", 1).cast("bigint"),
        F.lit("words"), (F.length(hit) - F.length(F.replace(hit, F.lit("#"), F.lit("")))).cast("bigint"),
    ))


def _base(text: Column) -> Column:
    places = lambda phrase, label: F.transform(
        _spans(text, F.lit(_numbered(_spaced(phrase)))), lambda s: F.named_struct(F.lit("label"), F.lit(label), F.lit("first"), s["first"])
    )
    return F.concat(*(places(phrase, label) for phrase, label in BASE))


def _detections(text: Column, found: list[Rule]) -> Column:
    """What the rules whose keywords stand in the text find, without what is suppressed."""
    table = F.array(*(
        F.named_struct(
            F.lit("rule"), F.lit(r.number), F.lit("label"), F.lit(r.label), F.lit("forms"), F.array(*map(F.lit, r.forms)),
            F.lit("names"), F.array(*map(F.lit, r.names)), F.lit("pattern"), F.lit(_numbered(r.pattern)),
            F.lit("priority"), F.lit(r.priority), F.lit("confidence"), F.lit(r.confidence),
        )
        for r in found
    ))
    has = lambda words: F.exists(words, lambda w: text.contains(w))
    ready = F.filter(table, lambda r: has(r["names"]) & has(r["forms"]))
    each = F.flatten(F.transform(ready, lambda r: F.transform(
        _spans(text, r["pattern"]),
        lambda s: F.named_struct(
            F.lit("first"), s["first"], F.lit("shorter"), -s["words"], F.lit("lower"), -r["priority"], F.lit("rule"), r["rule"],
            F.lit("label"), r["label"], F.lit("confidence"), r["confidence"],
        ),
    )))
    # Whatever contains a detection comes before it in this order, so the furthest end so far of each priority decides.
    levels = max(r.priority for r in found) + 1
    none = F.array().cast(_SORTED)
    state = lambda kept, ends: F.named_struct(F.lit("kept"), kept, F.lit("ends"), ends)

    def turn(now: Column, d: Column) -> Column:
        end, priority = d["first"] - d["shorter"], -d["lower"]
        inside = F.array_max(F.slice(now["ends"], priority + 1, F.lit(levels))) >= end
        ends = F.transform(now["ends"], lambda e, i: F.when(i == priority, F.greatest(e, end)).otherwise(e))
        return state(F.when(inside, now["kept"]).otherwise(F.concat(now["kept"], F.array(d))), ends)

    # In parts of FOLD: a fold that appends copies what it has, so a long one would cost the square of its length.
    def part(now: Column, few: Column) -> Column:
        inner = F.aggregate(few, state(none, now["ends"]), turn)
        return bind(inner, lambda x: state(F.concat(now["kept"], F.array(x["kept"])), x["ends"]))

    def settled(each: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(each), F.lit(1)), F.lit(FOLD)), lambda at: F.slice(each, at, FOLD))
        start = state(F.array().cast(f"array<{_SORTED}>"), F.array_repeat(F.lit(-1).cast("bigint"), levels))
        return F.aggregate(parts, start, part, lambda now: F.flatten(now["kept"]))

    left = bind(F.array_sort(each), settled)
    return F.transform(left, lambda d: F.named_struct(
        F.lit("rule"), d["rule"], F.lit("label"), d["label"], F.lit("first"), d["first"], F.lit("words"), -d["shorter"],
        F.lit("priority"), -d["lower"], F.lit("confidence"), d["confidence"],
    ))
