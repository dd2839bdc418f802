"""Signature rules for license scans: what licenses are called, and sentences of their notices.

Rules see words that are lower-cased and joined by one space, so ``GPL-3.0`` reads ``gpl 3 0``
and ``BSD-3-Clause`` reads ``bsd 3 clause``.  The order of rules decides between rules of one
priority that find the same words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Priorities, strongest first, and how sure a detection is.
IDENTIFIER, NOTICE, NAMED, MENTION = 0, 1, 2, 3
SURE = {IDENTIFIER: 1.0, NOTICE: 0.95, NAMED: 0.8, MENTION: 0.5}


@dataclass(frozen=True)
class Rule:
    """A regex for ``label``.  Every match has one of the words ``gates`` and the words ``head``."""

    label: str
    priority: int
    gates: tuple[str, ...]
    head: str
    pattern: str
    base: bool = False


#: (label, words that every name has, name, identifier): names are read before "license", identifiers alone.
LICENSES = [
    ("mit-0", "mit", "mit(?: no attribution| 0)", "mit 0"),
    ("mit", "mit", "(?:expat )?mit(?: style| expat)?", "mit"),
    ("x11", "x11", "(?:mit )?x11(?: style)?", "x11"),
    ("isc", "isc", "isc(?: style)?", "isc"),
    ("0bsd", "bsd", "(?:0 clause bsd|bsd 0 clause|bsd zero clause)", "0bsd"),
    ("bsd-2", "bsd", "(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause)(?: simplified)?", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause)(?: new| revised)?", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause)(?: original)?", "bsd 4 clause"),
    ("bsd", "bsd", "(?:berkeley )?bsd(?: style)?", "bsd"),
    ("apache-1", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version| v)? 1 0", "apache 1 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version| v)? (?:v2|2)(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache(?: software)?", None),
    ("gpl-1", "gnu", "gnu (?:gpl|general public licen[cs]e)(?: version| v)? (?:v1|1)(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gnu", "gnu (?:gpl|general public licen[cs]e)(?: version| v)? (?:v2|2)(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gnu", "gnu (?:gpl|general public licen[cs]e)(?: version| v)? (?:v3|3)(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gnu", "gnu (?:gpl|general public)", None),
    ("lgpl-2", "gnu", "gnu (?:lgpl|library general public licen[cs]e)(?: version| v)? (?:v2|2)(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "gnu", "gnu (?:lgpl|lesser general public licen[cs]e)(?: version| v)? (?:v2|2) 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "gnu", "gnu (?:lgpl|lesser general public licen[cs]e)(?: version| v)? (?:v3|3)(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "gnu", "gnu (?:lgpl|lesser general public|library general public)", None),
    ("agpl-3", "gnu", "gnu (?:agpl|affero general public licen[cs]e)(?: version| v)? (?:v3|3)(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public", None),
    ("gfdl-1.1", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 1", "gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3", "gfdl 1 3(?: only| or later)?"),
    ("gfdl", "documentation", "(?:gnu )?free documentation", None),
    ("mpl-1", "mozilla", "mozilla public licen[cs]e(?: version| v)? 1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public", None),
    ("epl-1", "eclipse", "eclipse public licen[cs]e(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public", None),
    ("edl-1", "eclipse", "eclipse distribution", None),
    ("cddl-1", "distribution", "common development and distribution licen[cs]e(?: version| v)? 1(?: 0)?", "cddl 1 0"),
    ("cddl-1.1", "distribution", "common development and distribution licen[cs]e(?: version| v)? 1 1", "cddl 1 1"),
    ("cddl", "distribution", "common development and distribution", None),
    ("cpl-1", "common", "common public", "cpl 1 0"),
    ("ipl-1", "ibm", "ibm public", "ipl 1 0"),
    ("eupl-1.1", "union", "european union public licen[cs]e(?: version| v)? 1 1", "eupl 1 1"),
    ("eupl-1.2", "union", "european union public licen[cs]e(?: version| v)? 1 2", "eupl 1 2"),
    ("eupl", "union", "european union public", None),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)? 2 1", "cecill 2 1"),
    ("cecill", "cecill", "cecill(?: free software)?", None),
    ("artistic-1", "artistic", "artistic(?: licen[cs]e)?(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic(?: licen[cs]e)?(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "(?:perl |clarified )?artistic", None),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng(?: reference library)?", "libpng(?: 2 0)?"),
    ("boost-1", "boost", "boost software(?: licen[cs]e)?(?: version| v)?(?: 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business", "business source(?: licen[cs]e)?(?: version| v)?(?: 1 1)?", "busl 1 1"),
    ("elastic-2", "elastic", "elastic(?: licen[cs]e)?(?: version| v)?(?: 2(?: 0)?)?", "elastic 2 0"),
    ("sspl-1", "server", "server side public(?: licen[cs]e)?(?: version| v)?(?: 1)?", "sspl 1 0"),
    ("python-2", "python", "python(?: software foundation)?(?: licen[cs]e)?(?: version| v)? 2(?: 0)?", "python 2 0(?: 1)?"),
    ("psf", "python", "python software foundation", "psf 2 0"),
    ("php-3", "php", "php(?: licen[cs]e)?(?: version| v)? 3(?: 0)?", "php 3 0"),
    ("php-3.01", "php", "php(?: licen[cs]e)?(?: version| v)? 3 01", "php 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("vim", "vim", "vim", "vim"),
    ("w3c", "w3c", "w3c(?: software(?: notice and)?| document)?", "w3c"),
    ("openssl", "openssl", "openssl(?: and ssleay)?", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("curl", "curl", "curl", "curl"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "what", "do what the fuck you want to public", None),
    ("beerware", "beer", "beer ware", "beerware"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "ms rl"),
    ("osl-3", "open", "open software(?: licen[cs]e)?(?: version| v)?(?: 3 0)?", "osl 3 0"),
    ("afl-3", "academic", "academic free(?: licen[cs]e)?(?: version| v)?(?: 3 0)?", "afl 3 0"),
    ("ecl-2", "educational", "educational community(?: licen[cs]e)?(?: version| v)?(?: 2 0)?", "ecl 2 0"),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source", "ncsa"),
    ("ofl-1.1", "font", "(?:sil )?open font(?: licen[cs]e)?(?: version| v)?(?: 1 1)?", "ofl 1 1"),
    ("lppl-1.3", "latex", "latex project public(?: licen[cs]e)?(?: version| v)?(?: 1 3c?)?", "lppl 1 3c?"),
    ("qpl-1", "public", "q public", "qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat", "sleepycat"),
    ("odbl-1", "database", "(?:odc )?open database", "odbl 1 0"),
    ("odc-by-1", "commons", "open data commons attribution", "odc by 1 0"),
    ("pddl-1", "domain", "(?:odc )?public domain dedication", "pddl 1 0"),
    ("openrail", "openrail", "(?:creativeml |bigscience |responsible ai )?openrail(?: m)?", "openrail(?: m)?"),
]

#: Creative Commons: (label, parts in short form, parts in full).
COMMONS = [
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by", "by", "attribution"),
    ("cc0", "0", "zero"),
]

_LICENSE, _LICENSED = ("license", "licence"), ("licensed", "licenced")

#: Sentences of notices and other wordings, by hand: (label, priority, gates, head, pattern).
NOTICES = [
    ("mit", NOTICE, ("permission",), "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", NOTICE, ("permission",), "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", NOTICE, ("redistribution",), "binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", NOTICE, ("contributors",), "endorse", "neither the name of(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4", NOTICE, ("advertising",), "materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", NOTICE, _LICENSED, "apache", "licen[cs]ed under the apache licen[cs]e version 2 0 the license you may not use this file"),
    ("apache-2", NOTICE, _LICENSE, "org", "(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("gpl", NOTICE, ("redistribute",), "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", NOTICE, ("redistribute",), "lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", NOTICE, ("redistribute",), "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-3", NOTICE, _LICENSE, "gnu", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", NOTICE, _LICENSE, "gnu", "gnu general public license as published by the free software foundation either version 2"),
    ("mpl-2", NOTICE, ("mozilla",), "source", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", NOTICE, ("mozilla",), "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", NOTICE, ("eclipse",), "accompanying", "accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", NOTICE, ("eclipse",), "accompanying", "accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl", NOTICE, ("distribution",), "subject", "subject to the terms of the common development and distribution license"),
    ("boost-1", NOTICE, ("boost",), "distributed", "distributed under the boost software license version 1 0"),
    ("zlib", NOTICE, ("permission",), "applications", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", NOTICE, ("unencumbered",), "domain", "free and unencumbered software released into the public domain"),
    ("wtfpl", NOTICE, ("wtfpl",), "wtfpl", "(?:licen[cs]ed |released )?under (?:the )?wtfpl"),
    ("beerware", NOTICE, ("whatever",), "stuff", "you can do whatever you want with this stuff"),
    ("public-domain", NAMED, ("domain",), "public", "(?:released|placed|dedicated|donated|given) (?:in|into|to) the public domain"),
    ("public-domain", MENTION, ("domain",), "public", "(?:this (?:work|file|text|software) is )?in the public domain"),
    ("proprietary", NAMED, ("confidential",), "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", NAMED, ("prohibited",), "copying", "unauthori[sz]ed copying of this (?:file|work|document)(?: via any medium)? is strictly prohibited"),
    ("proprietary", MENTION, ("reserved",), "rights", "all rights reserved"),
    ("proprietary", NAMED, ("permission",), "reproduced", "may not be reproduced(?: [^ ]+){0,6} without(?: the)?(?: prior)?(?: written)? permission"),
    ("proprietary", MENTION, ("redistribution",), "prohibited", "(?:redistribution|reproduction) (?:is )?(?:strictly )?prohibited"),
    ("non-commercial", NAMED, ("commercial",), "non", "(?:for )?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", NAMED, ("noncommercial",), "noncommercial", "(?:for )?noncommercial (?:use|purposes)(?: only)?"),
    ("gpl-2", NAMED, ("gplv2",), "gplv2", "(?:gnu )?gplv2(?: or later)?"),
    ("gpl-3", NAMED, ("gplv3",), "gplv3", "(?:gnu )?gplv3(?: or later)?"),
    ("lgpl-3", NAMED, ("lgplv3",), "lgplv3", "(?:gnu )?lgplv3(?: or later)?"),
    ("agpl-3", NAMED, ("agplv3",), "agplv3", "(?:gnu )?agplv3(?: or later)?"),
    ("gpl", MENTION, ("gpl",), "gpl", "(?:gnu )?gpl"),
    ("lgpl", MENTION, ("lgpl",), "lgpl", "(?:gnu )?lgpl"),
    ("agpl", MENTION, ("agpl",), "agpl", "(?:gnu )?agpl"),
    ("unknown", MENTION, _LICENSED, "under", "licen[cs]ed under"),
    ("unknown", MENTION, _LICENSE, "see", "see (?:the )?(?:file )?licen[cs]e(?: file| txt| md)? for (?:more )?(?:details|information)"),
]


def rules() -> list[Rule]:
    """All rules in order: identifiers, notices, names by license, short identifiers, mentions."""
    out = []
    for label, _, _, name in LICENSES:
        if name:
            out.append(Rule(label, IDENTIFIER, ("spdx",), "identifier", f"spdx license identifier {name}"))
    for label, short, _ in COMMONS:
        out.append(Rule(label, IDENTIFIER, ("spdx",), "identifier", f"spdx license identifier {'cc' if label != 'cc0' else ''}{' ' if label != 'cc0' else 'cc'}{short}(?: [1-4] [05])?"))
    for label, priority, gates, head, pattern in NOTICES:
        out.append(Rule(label, priority, gates, head, pattern))
    for label, head, name, _ in LICENSES:
        out.append(Rule(label, NOTICE, _LICENSED, head, f"(?:dual )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{name}(?: (?:public )?licen[cs]e)?"))
        out.append(Rule(label, NOTICE, _LICENSE, head, f"(?:released|distributed|published|provided|available|shared|free) under (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e"))
        out.append(Rule(label, NAMED, _LICENSE, head, f"{name} licen[cs]e"))
        # Names that hold the word, with a version after it; and GNU's short names in its place.
        short = re.search(r"\(\?:(\w+)\|([^()]*licen\[cs\]e)\)", name)
        whole = name.replace(short[0], short[2]) if short else name.replace("(?: licen[cs]e)?", " licen[cs]e")
        if "licen[cs]e" in whole:
            out.append(Rule(label, NAMED, _LICENSE, head, whole))
        if short:
            out.append(Rule(label, NAMED, (short[1],), head, name.replace(short[0], short[1])))
    for label, short, full in COMMONS:
        for brief in ("cc 0", "cc0") if label == "cc0" else (f"cc {short}",):
            gate = brief.split(" ")[0]
            out.append(Rule(label, NAMED, (gate,), gate, f"(?:licen[cs]ed under )?(?:the |a )?{brief}(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"))
        out.append(Rule(label, NAMED, ("commons",), "creative", f"(?:licen[cs]ed under )?(?:the |a )?creative commons {full}(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"))
    for label, _, _, name in LICENSES:
        first = (name or "").split(" ")[0]
        if first in ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "eupl", "lppl", "odbl", "pddl", "sspl", "busl"):
            out.append(Rule(label, NAMED, (first,), first, name))
        elif label.startswith("bsd-"):
            out.append(Rule(label, NAMED, ("clause",), "bsd", name))
    return out
