"""Signature rules for licences, written for normalised text: lower-case words with one space between.

A rule is (label, priority, keyword, pattern): the keyword is a fixed part of everything that the pattern matches, and
is looked for first. Priority 3: an exact identifier; 2: a full name or notice with its version; 1: a name without a
version or a typical clause; 0: a hint. Patterns have no unbounded part, so a match is at most some tens of words.
"""

from __future__ import annotations

_V = "(?:version |v )?"
_LIC = "licen[sc]e"

#: label: (keyword, patterns) of each priority, 3 first.
_TABLE: list[tuple[str, int, str, list[str]]] = [
    # SPDX identifiers
    ("spdx-mit", 3, "spdx license identifier", ["spdx license identifier mit"]),
    ("apache-2.0", 3, "spdx license identifier", ["spdx license identifier apache 2 0"]),
    ("apache-1.1", 3, "spdx license identifier", ["spdx license identifier apache 1 1"]),
    ("gpl-2.0", 3, "spdx license identifier", ["spdx license identifier gpl 2 0(?: only)?"]),
    ("gpl-2.0-or-later", 3, "spdx license identifier", ["spdx license identifier gpl 2 0 or later"]),
    ("gpl-3.0", 3, "spdx license identifier", ["spdx license identifier gpl 3 0(?: only)?"]),
    ("gpl-3.0-or-later", 3, "spdx license identifier", ["spdx license identifier gpl 3 0 or later"]),
    ("lgpl-2.1", 3, "spdx license identifier", ["spdx license identifier lgpl 2 1(?: only| or later)?"]),
    ("lgpl-3.0", 3, "spdx license identifier", ["spdx license identifier lgpl 3 0(?: only| or later)?"]),
    ("agpl-3.0", 3, "spdx license identifier", ["spdx license identifier agpl 3 0(?: only| or later)?"]),
    ("bsd-2-clause", 3, "spdx license identifier", ["spdx license identifier bsd 2 clause"]),
    ("bsd-3-clause", 3, "spdx license identifier", ["spdx license identifier bsd 3 clause"]),
    ("bsd-4-clause", 3, "spdx license identifier", ["spdx license identifier bsd 4 clause"]),
    ("0bsd", 3, "spdx license identifier", ["spdx license identifier 0bsd"]),
    ("mpl-1.1", 3, "spdx license identifier", ["spdx license identifier mpl 1 1"]),
    ("mpl-2.0", 3, "spdx license identifier", ["spdx license identifier mpl 2 0"]),
    ("epl-1.0", 3, "spdx license identifier", ["spdx license identifier epl 1 0"]),
    ("epl-2.0", 3, "spdx license identifier", ["spdx license identifier epl 2 0"]),
    ("cddl-1.0", 3, "spdx license identifier", ["spdx license identifier cddl 1 0"]),
    ("isc", 3, "spdx license identifier", ["spdx license identifier isc"]),
    ("zlib", 3, "spdx license identifier", ["spdx license identifier zlib"]),
    ("unlicense", 3, "spdx license identifier", ["spdx license identifier unlicense"]),
    ("cc0-1.0", 3, "spdx license identifier", ["spdx license identifier cc0 1 0"]),
    ("bsl-1.0", 3, "spdx license identifier", ["spdx license identifier bsl 1 0"]),
    ("eupl-1.2", 3, "spdx license identifier", ["spdx license identifier eupl 1 2"]),
    ("artistic-2.0", 3, "spdx license identifier", ["spdx license identifier artistic 2 0"]),
    ("wtfpl", 3, "spdx license identifier", ["spdx license identifier wtfpl"]),
    ("ofl-1.1", 3, "spdx license identifier", ["spdx license identifier ofl 1 1"]),
    ("spdx", 1, "spdx license identifier", ["spdx license identifier [^ ]{1,40}"]),
    # addresses of licence texts
    ("apache-2.0", 3, "apache org licenses", ["https? (?:www )?apache org licenses license 2 0(?: txt| html)?"]),
    ("apache", 1, "apache org licenses", ["https? (?:www )?apache org licenses"]),
    ("mit", 3, "opensource org licenses mit", ["https? (?:www )?opensource org licenses mit(?: license)?(?: php| html)?"]),
    ("bsd-2-clause", 3, "opensource org licenses bsd", ["https? (?:www )?opensource org licenses bsd 2 clause"]),
    ("bsd-3-clause", 3, "opensource org licenses bsd", ["https? (?:www )?opensource org licenses bsd 3 clause"]),
    ("isc", 3, "opensource org licenses isc", ["https? (?:www )?opensource org licenses isc"]),
    ("osi", 0, "opensource org licenses", ["https? (?:www )?opensource org licenses"]),
    ("mpl-2.0", 3, "mozilla org mpl", ["https? (?:www )?mozilla org mpl 2 0"]),
    ("mpl-1.1", 3, "mozilla org mpl", ["https? (?:www )?mozilla org mpl (?:mpl )?1 1"]),
    ("epl-1.0", 3, "eclipse org legal epl", ["https? (?:www )?eclipse org legal epl v10(?: html)?"]),
    ("epl-2.0", 3, "eclipse org legal epl", ["https? (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"]),
    ("gpl", 2, "gnu org licenses", ["https? (?:www )?gnu org licenses gpl(?: [23] 0)?(?: html| txt)?", "https? (?:www )?gnu org licenses old licenses gpl 2 0(?: html| txt)?"]),
    ("lgpl", 2, "gnu org licenses", ["https? (?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"]),
    ("agpl", 2, "gnu org licenses", ["https? (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"]),
    ("gfdl", 2, "gnu org licenses", ["https? (?:www )?gnu org licenses fdl(?: 1 [1-3])?(?: html| txt)?"]),
    ("cc-by", 3, "creativecommons org licenses by", ["https? (?:www )?creativecommons org licenses by [1-4] [05]"]),
    ("cc-by-sa", 3, "creativecommons org licenses by sa", ["https? (?:www )?creativecommons org licenses by sa [1-4] [05]"]),
    ("cc-by-nc", 3, "creativecommons org licenses by nc", ["https? (?:www )?creativecommons org licenses by nc [1-4] [05]"]),
    ("cc-by-nd", 3, "creativecommons org licenses by nd", ["https? (?:www )?creativecommons org licenses by nd [1-4] [05]"]),
    ("cc-by-nc-sa", 3, "creativecommons org licenses by nc sa", ["https? (?:www )?creativecommons org licenses by nc sa [1-4] [05]"]),
    ("cc-by-nc-nd", 3, "creativecommons org licenses by nc nd", ["https? (?:www )?creativecommons org licenses by nc nd [1-4] [05]"]),
    ("cc0-1.0", 3, "creativecommons org publicdomain zero", ["https? (?:www )?creativecommons org publicdomain zero 1 0"]),
    ("public-domain", 2, "creativecommons org publicdomain mark", ["https? (?:www )?creativecommons org publicdomain mark 1 0"]),
    ("unlicense", 3, "unlicense org", ["https? (?:www )?unlicense org"]),
    ("wtfpl", 3, "wtfpl net", ["https? (?:www )?wtfpl net"]),
    ("bsl-1.0", 3, "boost org license", ["https? (?:www )?boost org license 1 0 txt"]),
    ("ofl-1.1", 3, "scripts sil org ofl", ["https? scripts sil org ofl"]),
    # Creative Commons
    ("cc-by", 2, "cc by", ["cc by [1-4] [05]", "cc by v[1-4]"]),
    ("cc-by-sa", 2, "cc by sa", ["cc by sa [1-4] [05]", "cc by sa v[1-4]"]),
    ("cc-by-nc", 2, "cc by nc", ["cc by nc [1-4] [05]", "cc by nc v[1-4]"]),
    ("cc-by-nd", 2, "cc by nd", ["cc by nd [1-4] [05]", "cc by nd v[1-4]"]),
    ("cc-by-nc-sa", 2, "cc by nc sa", ["cc by nc sa [1-4] [05]", "cc by nc sa v[1-4]"]),
    ("cc-by-nc-nd", 2, "cc by nc nd", ["cc by nc nd [1-4] [05]", "cc by nc nd v[1-4]"]),
    ("cc-by-sa", 1, "cc by sa", ["cc by sa"]),
    ("cc-by-nc", 1, "cc by nc", ["cc by nc"]),
    ("cc-by-nd", 1, "cc by nd", ["cc by nd"]),
    ("cc-by-nc-sa", 1, "cc by nc sa", ["cc by nc sa"]),
    ("cc-by-nc-nd", 1, "cc by nc nd", ["cc by nc nd"]),
    ("cc-by", 2, "creative commons attribution", ["creative commons attribution [1-4] [05](?: international| unported| generic)?"]),
    ("cc-by-sa", 2, "creative commons attribution share", [f"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: {_LIC})?"]),
    ("cc-by-nc", 2, "creative commons attribution non", [f"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: {_LIC})?"]),
    ("cc-by-nd", 2, "creative commons attribution no", [f"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?(?: {_LIC})?"]),
    ("cc-by-nc-sa", 2, "creative commons attribution non", [f"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: {_LIC})?"]),
    ("cc-by-nc-nd", 2, "creative commons attribution non", [f"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported)?(?: {_LIC})?"]),
    ("cc-by", 1, "creative commons attribution", [f"creative commons attribution {_LIC}"]),
    ("cc0-1.0", 2, "cc0", ["cc0 1 0(?: universal)?", "cc0 universal"]),
    ("cc0-1.0", 1, "cc0", ["cc0"]),
    ("cc0-1.0", 2, "creative commons zero", ["creative commons zero(?: v1 0| 1 0)?(?: universal)?"]),
    ("cc", 0, "creative commons", [f"creative commons(?: {_LIC})?"]),
    # GNU
    ("gpl-1.0", 2, "general public licen", [f"(?:gnu )?general public {_LIC} {_V}1(?: 0)?"]),
    ("gpl-2.0", 2, "general public licen", [f"(?:gnu )?general public {_LIC} {_V}2(?: 0)?"]),
    ("gpl-3.0", 2, "general public licen", [f"(?:gnu )?general public {_LIC} {_V}3(?: 0)?"]),
    ("gpl-2.0", 2, "general public licen", [f"version 2 of the (?:gnu )?general public {_LIC}"]),
    ("gpl-3.0", 2, "general public licen", [f"version 3 of the (?:gnu )?general public {_LIC}"]),
    ("gpl-2.0-or-later", 2, "general public licen", [f"general public {_LIC} as published by the free software foundation either version 2 of the {_LIC} or at your option any later version"]),
    ("gpl-3.0-or-later", 2, "general public licen", [f"general public {_LIC} as published by the free software foundation either version 3 of the {_LIC} or at your option any later version"]),
    ("gpl", 1, "general public licen", [f"gnu general public {_LIC}"]),
    ("gpl", 1, "gpl", ["gnu gpl", f"gpl {_LIC}", "gpl compatible", "licensed under (?:the )?gpl"]),
    ("gpl-2.0", 2, "gpl", ["gpl ?v2", "gpl 2 0", "gpl version 2", "gpl2"]),
    ("gpl-3.0", 2, "gpl", ["gpl ?v3", "gpl 3 0", "gpl version 3", "gpl3"]),
    ("gpl-2.0-or-later", 2, "gpl", ["gpl ?v?2 (?:0 )?or later", "gpl ?v?2 (?:0 )?plus"]),
    ("gpl-3.0-or-later", 2, "gpl", ["gpl ?v?3 (?:0 )?or later", "gpl ?v?3 (?:0 )?plus"]),
    ("lgpl-2.0", 2, "lesser general public", [f"(?:gnu )?lesser general public {_LIC} {_V}2 0"]),
    ("lgpl-2.1", 2, "lesser general public", [f"(?:gnu )?lesser general public {_LIC} {_V}2 1"]),
    ("lgpl-3.0", 2, "lesser general public", [f"(?:gnu )?lesser general public {_LIC} {_V}3(?: 0)?"]),
    ("lgpl", 1, "lesser general public", [f"(?:gnu )?lesser general public {_LIC}"]),
    ("lgpl-2.0", 2, "library general public", [f"(?:gnu )?library general public {_LIC}(?: {_V}2(?: 0)?)?"]),
    ("lgpl-2.1", 2, "lgpl", ["lgpl ?v?2 1", "lgpl version 2 1"]),
    ("lgpl-3.0", 2, "lgpl", ["lgpl ?v?3(?: 0)?", "lgpl version 3"]),
    ("lgpl", 1, "lgpl", ["gnu lgpl", "lgpl"]),
    ("agpl-3.0", 2, "affero general public", [f"(?:gnu )?affero general public {_LIC} {_V}3(?: 0)?"]),
    ("agpl", 1, "affero general public", [f"(?:gnu )?affero general public {_LIC}"]),
    ("agpl-3.0", 2, "agpl", ["agpl ?v?3(?: 0)?", "agpl version 3"]),
    ("agpl", 1, "agpl", ["gnu agpl", "agpl"]),
    ("gfdl-1.2", 2, "free documentation licen", [f"gnu free documentation {_LIC} {_V}1 2"]),
    ("gfdl-1.3", 2, "free documentation licen", [f"gnu free documentation {_LIC} {_V}1 3"]),
    ("gfdl", 1, "free documentation licen", [f"gnu free documentation {_LIC}"]),
    ("gpl", 0, "free software foundation", ["as published by the free software foundation"]),
    # Apache
    ("apache-2.0", 2, "apache licen", [f"apache {_LIC} {_V}2(?: 0)?", f"licensed under the apache {_LIC} {_V}2 0(?: the {_LIC})?"]),
    ("apache-1.1", 2, "apache licen", [f"apache {_LIC} {_V}1 1"]),
    ("apache-1.0", 2, "apache licen", [f"apache {_LIC} {_V}1 0"]),
    ("apache-2.0", 2, "apache", ["apache 2 0(?: licen[sc]e(?:d)?)?", "apache2"]),
    ("apache-2.0", 2, "asl 2 0", ["asl 2 0"]),
    ("apache", 1, "apache licen", [f"apache {_LIC}"]),
    ("apache", 1, "apache software licen", [f"apache software {_LIC}(?: {_V}[12] [01])?"]),
    ("apache-2.0", 1, "you may not use this file except", ["you may not use this file except in compliance with the licen[sc]e"]),
    # MIT and its kin
    ("mit", 2, "mit licen", [f"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?mit {_LIC}"]),
    ("mit", 1, "mit licen", [f"(?:the )?mit {_LIC}", "mit licensed"]),
    ("mit", 2, "permission is hereby granted", ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]),
    ("mit", 1, "the above copyright notice and this", ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    ("mit-0", 2, "mit no attribution", ["mit no attribution"]),
    ("x11", 2, "x11 licen", [f"x11 {_LIC}"]),
    ("expat", 2, "expat licen", [f"expat {_LIC}"]),
    ("isc", 2, "isc licen", [f"(?:the )?isc {_LIC}"]),
    ("isc", 2, "permission to use copy modify", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("ntp", 1, "permission to use copy modify", ["permission to use copy modify and distribute this software and its documentation"]),
    ("permissive-warranty", 0, "the software is provided as is", ["the software is provided as is without warranty of any kind"]),
    ("permissive-warranty", 0, "provided by the copyright holders", ["this software is provided by the copyright holders and contributors as is"]),
    # BSD
    ("bsd-2-clause", 2, "bsd", [f"bsd 2 clause(?: {_LIC})?", f"2 clause bsd(?: {_LIC})?", f"simplified bsd(?: {_LIC})?", f"freebsd {_LIC}"][:3]),
    ("bsd-3-clause", 2, "bsd", [f"bsd 3 clause(?: {_LIC})?", f"3 clause bsd(?: {_LIC})?", f"new bsd {_LIC}", f"modified bsd {_LIC}", f"revised bsd {_LIC}"]),
    ("bsd-4-clause", 2, "bsd", [f"bsd 4 clause(?: {_LIC})?", f"4 clause bsd(?: {_LIC})?", f"original bsd {_LIC}"]),
    ("bsd-2-clause", 2, "freebsd", [f"freebsd {_LIC}"]),
    ("0bsd", 2, "bsd", [f"bsd 0 clause(?: {_LIC})?", f"0 clause bsd(?: {_LIC})?", f"zero clause bsd(?: {_LIC})?", f"0bsd {_LIC}"]),
    ("bsd", 1, "bsd", [f"bsd {_LIC}", "bsd licensed", f"bsd style {_LIC}"]),
    ("bsd", 1, "redistribution and use in source", ["redistribution and use in source and binary forms with or without modification are permitted"]),
    ("bsd-3-clause", 1, "may be used to endorse or promote", ["may be used to endorse or promote products derived from this software without specific prior written permission"]),
    ("bsd-4-clause", 1, "all advertising materials", ["all advertising materials mentioning features or use of this software must display"]),
    # Mozilla, Eclipse, Sun, IBM, Microsoft
    ("mpl-1.0", 2, "mozilla public licen", [f"mozilla public {_LIC} {_V}1 0"]),
    ("mpl-1.1", 2, "mozilla public licen", [f"mozilla public {_LIC} {_V}1 1"]),
    ("mpl-2.0", 2, "mozilla public licen", [f"mozilla public {_LIC} {_V}2(?: 0)?"]),
    ("mpl", 1, "mozilla public licen", [f"mozilla public {_LIC}"]),
    ("mpl-2.0", 2, "mpl", ["mpl ?v?2 0", "mpl ?v?2"]),
    ("mpl-1.1", 2, "mpl", ["mpl ?v?1 1"]),
    ("epl-1.0", 2, "eclipse public licen", [f"eclipse public {_LIC} {_V}1(?: 0)?"]),
    ("epl-2.0", 2, "eclipse public licen", [f"eclipse public {_LIC} {_V}2(?: 0)?"]),
    ("epl", 1, "eclipse public licen", [f"eclipse public {_LIC}"]),
    ("cddl-1.0", 2, "common development and distribution", [f"common development and distribution {_LIC}(?: {_V}1 [01])?"]),
    ("cddl-1.0", 2, "cddl", ["cddl(?: ?v?1 [01])?"]),
    ("cpl-1.0", 2, "common public licen", [f"common public {_LIC}(?: {_V}1 0)?"]),
    ("cpal-1.0", 2, "common public attribution", [f"common public attribution {_LIC}(?: {_V}1 0)?"]),
    ("ipl-1.0", 2, "ibm public licen", [f"ibm public {_LIC}(?: {_V}1 0)?"]),
    ("ms-pl", 2, "microsoft public licen", [f"microsoft public {_LIC}"]),
    ("ms-rl", 2, "microsoft reciprocal licen", [f"microsoft reciprocal {_LIC}"]),
    ("ms-pl", 2, "ms pl", [f"ms pl {_LIC}"]),
    ("apsl-2.0", 2, "apple public source", [f"apple public source {_LIC}(?: {_V}[12] [0-2])?"]),
    ("upl-1.0", 2, "universal permissive", [f"universal permissive {_LIC}(?: {_V}1 0)?"]),
    ("nasa-1.3", 2, "nasa open source", ["nasa open source agreement(?: 1 3)?"]),
    ("bcl", 2, "oracle binary code", [f"oracle binary code {_LIC}"]),
    # others with a name
    ("zlib", 2, "zlib", [f"zlib(?: libpng)? {_LIC}"]),
    ("libpng", 2, "libpng licen", [f"libpng {_LIC}"]),
    ("zlib", 1, "in no event will the authors", ["in no event will the authors be held liable for any damages arising from the use of this software"]),
    ("bsl-1.0", 2, "boost software licen", [f"boost software {_LIC}(?: {_V}1 0)?"]),
    ("unlicense", 2, "unlicense", ["(?:the )?unlicense"]),
    ("unlicense", 2, "released into the public domain", ["this is free and unencumbered software released into the public domain"]),
    ("public-domain", 1, "public domain", ["(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain dedication"]),
    ("public-domain", 0, "public domain", ["in the public domain", "public domain"]),
    ("wtfpl", 2, "what the fuck you want", [f"do what the fuck you want to public {_LIC}"]),
    ("wtfpl", 1, "wtfpl", ["wtfpl"]),
    ("artistic-1.0", 2, "artistic licen", [f"artistic {_LIC} {_V}1 0"]),
    ("artistic-2.0", 2, "artistic licen", [f"artistic {_LIC} {_V}2 0"]),
    ("artistic", 1, "artistic licen", [f"(?:perl )?artistic {_LIC}"]),
    ("perl", 1, "same terms as perl", ["under the same terms as perl itself"]),
    ("psf-2.0", 2, "python software foundation", [f"python software foundation {_LIC}(?: {_V}2(?: 0)?)?"]),
    ("php-3.01", 2, "php licen", [f"php {_LIC}(?: {_V}3 01?)?"]),
    ("ruby", 2, "ruby licen", [f"ruby {_LIC}"]),
    ("openssl", 2, "openssl licen", [f"openssl {_LIC}"]),
    ("ssleay", 2, "ssleay licen", [f"ssleay {_LIC}"]),
    ("curl", 2, "curl licen", [f"curl {_LIC}"]),
    ("vim", 2, "vim licen", [f"vim {_LIC}"]),
    ("postgresql", 2, "postgresql licen", [f"postgresql {_LIC}"]),
    ("sqlite", 2, "sqlite", ["sqlite blessing"]),
    ("beerware", 2, "beer ware", [f"beer ware {_LIC}"]),
    ("json", 2, "shall be used for good", ["the software shall be used for good not evil"]),
    ("ofl-1.1", 2, "open font licen", [f"(?:sil )?open font {_LIC}(?: {_V}1 [01])?"]),
    ("eupl-1.1", 2, "european union public", [f"european union public {_LIC} {_V}1 1"]),
    ("eupl-1.2", 2, "european union public", [f"european union public {_LIC} {_V}1 2"]),
    ("eupl", 1, "european union public", [f"european union public {_LIC}"]),
    ("cecill-2.1", 2, "cecill", ["cecill(?: [bc])?(?: v?2(?: [01])?)?"]),
    ("osl-3.0", 2, "open software licen", [f"open software {_LIC}(?: {_V}[123] [01])?"]),
    ("afl-3.0", 2, "academic free licen", [f"academic free {_LIC}(?: {_V}[123] [01])?"]),
    ("ecl-2.0", 2, "educational community licen", [f"educational community {_LIC}(?: {_V}2 0)?"]),
    ("ncsa", 2, "illinois ncsa", [f"university of illinois ncsa(?: open source)? {_LIC}"]),
    ("w3c", 2, "w3c software", [f"w3c software (?:notice and )?(?:document )?{_LIC}"]),
    ("odbl-1.0", 2, "open database licen", [f"open database {_LIC}(?: {_V}1 0)?"]),
    ("odc-by-1.0", 2, "open data commons", [f"open data commons attribution {_LIC}(?: {_V}1 0)?"]),
    ("pddl-1.0", 2, "open data commons", ["open data commons public domain dedication(?: and licen[sc]e)?"]),
    ("ogl-uk-3.0", 2, "open government licen", [f"open government {_LIC}(?: {_V}[123](?: 0)?)?"]),
    ("bsl-1.1", 2, "business source licen", [f"business source {_LIC}(?: {_V}?1 1)?"]),
    ("sspl-1.0", 2, "server side public", [f"server side public {_LIC}(?: {_V}1)?"]),
    ("elastic-2.0", 2, "elastic licen", [f"elastic {_LIC}(?: {_V}?2(?: 0)?)?"]),
    ("commons-clause", 2, "commons clause", [f"commons clause(?: {_LIC})?(?: condition)?"]),
    ("polyform", 2, "polyform", [f"polyform (?:noncommercial|small business|shield|strict|internal use|perimeter|free trial)(?: {_LIC})?"]),
    ("parity", 2, "parity public", [f"parity public {_LIC}"]),
    ("blueoak-1.0", 2, "blue oak model", [f"blue oak model {_LIC}(?: 1 0 0)?"]),
    ("openrail", 2, "openrail", [f"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: {_LIC})?"]),
    ("openrail", 2, "open rail", [f"(?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: {_LIC})?"]),
    ("llama", 2, "llama", [f"llama (?:[23] )?(?:[0-9] )?community {_LIC}"]),
    ("hippocratic", 2, "hippocratic licen", [f"hippocratic {_LIC}"]),
    ("mulan-2.0", 2, "mulan", [f"mulan p(?:sl|ermissive software {_LIC})(?: ?v?2)?"]),
    ("anti-996", 2, "anti 996", [f"anti 996 {_LIC}"]),
    # proprietary notices and hints
    ("reserved", 1, "all rights reserved", ["(?:c )?copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: [^ ]{1,30}){1,6} all rights reserved", "all rights reserved"]),
    ("copyright", 0, "copyright", ["copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"]),
    ("proprietary", 2, "proprietary", ["proprietary and confidential", f"proprietary {_LIC}", "confidential and proprietary"]),
    ("proprietary", 1, "unauthori", ["unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: [^ ]{1,20}){0,8} is (?:strictly )?prohibited"]),
    ("proprietary", 1, "end user licen", [f"end user {_LIC}(?: agreement)?"]),
    ("proprietary", 1, "without prior written permission", ["(?:may|must) not be (?:copied|reproduced|redistributed)(?: [^ ]{1,20}){0,8} without prior written permission"]),
    ("noncommercial", 1, "non commercial use only", ["(?:for )?non commercial use only"]),
    ("noncommercial", 1, "personal use only", ["for personal use only"]),
    ("research-only", 1, "research purposes only", ["for (?:academic )?research purposes only"]),
    ("evaluation", 1, "evaluation purposes only", ["for evaluation purposes only"]),
    ("dual", 1, "dual licensed", ["dual licensed(?: under)?"]),
    ("unspecified", 0, "licensed under", ["licensed under (?:the )?(?:terms of )?(?:the |this )?[^ ]{1,30} licen[sc]e"]),
    ("unspecified", 0, "license", ["see (?:the )?license file for details", "license agreement", "license terms", "license file"]),
]

RULES: list[tuple[str, int, str, str]] = [(label, priority, key, pattern) for label, priority, key, patterns in _TABLE for pattern in patterns]

#: Every keyword has one of these in it: a text without any of them needs no rule.
GATES = (
    "licen", "cc by", "cc0", "creative", "gpl", "apache", "permission", "copyright", "software is", "bsd", "redistribution",
    "endorse", "advertising", "mpl", "common", "cddl", "universal", "nasa open", "oracle binary", "zlib", "in no event", "public", "what the fuck",
    "wtfpl", "same terms", "python software", "sqlite", "beer ware", "used for good", "european union", "cecill", "illinois", "w3c", "open data", "business source",
    "server side", "polyform", "openrail", "open rail", "llama", "mulan", "anti 996", "rights reserved", "proprietary", "unauthori", "use only", "purposes only", "free software",
    "you may not use", "boost org", "sil org", "mozilla org", "eclipse org", "ms pl", "mit no", "blue oak", "general", "asl 2 0",
)

CONFIDENCE = {3: 0.99, 2: 0.9, 1: 0.7, 0: 0.4}
