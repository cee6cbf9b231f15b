"""License scans by ordered signature rules, in DataFrame functions only.

A text, A-Z in lower case, becomes its words with one blank around each. The base labels come from the places where a
phrase's words stand consecutively. The method's rules (RULES) are regular expressions over these words, written one by one:
wordings of licenses, notices, SPDX expressions, names with and without version. Each has a priority, a label and a keyword; a
rule looks only at texts that hold its keyword, and texts that hold none of them, nor a word for license where rules have one,
are not looked at by any. Each match is an interval of the text. Of overlapping detections one that lies
inside the interval of another (or fills it) is suppressed if the other has a higher priority (a smaller number), or the same
and is longer or of an earlier rule; detections that merely overlap stay. The score is the confidence of the best priority
kept; a base label has 1.

Null and empty texts: no words, no labels (empty strings), null places, score 0. No documents: no rows. Ties: the earlier rule.
Repeated rows each get their own result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import table

# The phrases and labels of the base.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Short forms in the rules. L: license; V: before a version; E: an SPDX expression up to here; P: as the FSF's notices go on.
SHORT = {
    "{L}": "licen[cs]e",
    "{V}": "(?: licen[cs]e)?(?: version| v| ver)? ?",
    "{E}": "(?<= spdx licen[cs]e identifier (?:[a-z0-9 ]{1,80} (?:or|and) |))",
    "{P}": " as published by the free software foundation(?: either)? version ",
    "{LATER}": "(?: or(?: at your option any)? later| only)?",
}
#: Priority, label, keyword, pattern. Every pattern starts at a word and ends before a blank.
RULES = r"""
1 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 | mit | copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit | without warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
1 | mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
1 | x11 | advertising or otherwise | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
1 | isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
1 | isc | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
1 | bsd-0 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
1 | hpnd | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
1 | bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 | bsd | redistributions of source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 | bsd | redistributions in binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
1 | bsd-3 | endorse or promote | neither the (?:name|names) of [a-z0-9 ]{1,80}? (?:nor the names of (?:its|other|any) contributors )?may be used to endorse or promote products derived from this software
1 | bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
1 | bsd-2 | freebsd project | those of the authors and should not be interpreted as representing official policies either expressed or implied of the freebsd project
1 | bsd-patent | patent | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable
1 | apache-2 | apache | licensed under the apache {L} version 2 0 the {L} you may not use this (?:file|software|work|project) except in compliance with the {L}
1 | apache-2 | apache | apache {L} version 2 0 january 2004
1 | apache-2 | apache org | (?:https? )?(?:www )?apache org licenses {L} 2 0(?: txt| html)?
1 | apache-1 | apache | this product includes software developed by the apache (?:software foundation|group)
1 | gpl-1 | general public | gnu general public {L}{P}1
1 | gpl-2 | general public | gnu general public {L}{P}2{LATER}
1 | gpl-3 | general public | gnu general public {L}{P}3{LATER}
1 | gpl-2 | general public | gnu general public {L} version 2 june 1991
1 | gpl-3 | general public | gnu general public {L} version 3 29 june 2007
1 | lgpl-2 | general public | gnu (?:lesser|library) general public {L}{P}2(?: [01])?{LATER}
1 | lgpl-3 | general public | gnu lesser general public {L}{P}3(?: 0)?{LATER}
1 | lgpl-2 | general public | gnu lesser general public {L} version 2 1 february 1999
1 | lgpl-3 | general public | gnu lesser general public {L} version 3 29 june 2007
1 | agpl-3 | affero | gnu affero general public {L}{P}3{LATER}
1 | agpl-3 | affero | gnu affero general public {L} version 3 19 november 2007
1 | gpl | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public {L}
1 | lgpl | free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {L}
1 | gpl | without any warranty | without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public {L}
1 | gpl | copyleft | is a free copyleft {L} for software and other kinds of works
1 | gfdl | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}
1 | mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public {L} v ?2 0
1 | mpl-1 | mozilla | the contents of this file are subject to the mozilla public {L} version 1 [01]
1 | mpl-2 | mozilla | if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?mozilla org mpl 2 0
1 | epl-1 | eclipse | made available under the terms of the eclipse public {L} v ?1 0
1 | epl-2 | eclipse | made available under the terms of the eclipse public {L} (?:v ?)?2 0
1 | cddl | common development | the contents of this file are subject to the terms of the common development and distribution {L}
1 | cpl | common public | the accompanying program is provided under the terms of this common public {L}
1 | bsl | boost | boost software {L} version 1 0 august 17th 2003
1 | bsl | boost | distributed under the boost software {L} version 1 0
1 | bsl | person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this {L}
1 | unlicense | public domain | this is free and unencumbered software released into the public domain
1 | wtfpl | what the fuck | you just do what the fuck you want to
1 | wtfpl | what the fuck | do what the fuck you want to public {L}
1 | zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
1 | zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
1 | ncsa | illinois | university of illinois ncsa open source {L}
1 | ncsa | with the software | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
1 | openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
1 | ssleay | eric young | this product includes cryptographic software written by eric young
1 | php | php | this product includes php software freely available from
1 | python | python | python software foundation {L} version 2
1 | python | psf | this {L} agreement is between the python software foundation psf
1 | postgresql | postgresql | postgresql database management system formerly known as postgres
1 | artistic-2 | artistic | everyone is permitted to copy and distribute verbatim copies of this {L} document but changing it is not allowed
1 | artistic | artistic | the intent of this document is to state the conditions under which a package may be copied
1 | perl | perl | this (?:library|program|module|software) is free software you can redistribute it and or modify it under the same terms as perl itself
1 | perl | perl | under the same terms as (?:the )?perl(?: 5)?(?: itself| programming language system itself)
1 | ofl | sil open font | this font software is licensed under the sil open font {L} version 1 [01]
1 | ofl | font software | permission is hereby granted free of charge to any person obtaining a copy of the font software
1 | cc0 | creative commons | the person who associated a work with this deed has dedicated the work to the public domain
1 | cc-by | creativecommons org | creativecommons org licenses by [1-4] [05]
1 | cc-by-sa | creativecommons org | creativecommons org licenses by sa [1-4] [05]
1 | cc-by-nd | creativecommons org | creativecommons org licenses by nd [1-4] [05]
1 | cc-by-nc | creativecommons org | creativecommons org licenses by nc [1-4] [05]
1 | cc-by-nc-sa | creativecommons org | creativecommons org licenses by nc sa [1-4] [05]
1 | cc-by-nc-nd | creativecommons org | creativecommons org licenses by nc nd [1-4] [05]
1 | cc0 | creativecommons org | creativecommons org publicdomain zero 1 0
1 | public-domain | creativecommons org | creativecommons org publicdomain mark 1 0
1 | sspl | server side | server side public {L} version 1 october 16 2018
1 | busl | business source | business source {L} 1 1
1 | elastic | elastic | elastic {L} 2 0
1 | eupl | european union | licensed under the eupl
1 | ms-pl | microsoft | microsoft public {L} ms pl
1 | ms-rl | microsoft | microsoft reciprocal {L} ms rl
1 | vim | vim | there are no restrictions on distributing unmodified copies of vim
1 | beerware | beer ware | as long as you retain this notice you can do whatever you want with this stuff
1 | json | not evil | the software shall be used for good not evil
1 | mit | spdx | {E}mit(?= |$)
1 | mit-0 | spdx | {E}mit 0
1 | apache-1 | spdx | {E}apache 1 [01]
1 | apache-2 | spdx | {E}apache 2 0
1 | bsd-0 | spdx | {E}0bsd
1 | bsd-2 | spdx | {E}bsd 2 clause
1 | bsd-3 | spdx | {E}bsd 3 clause
1 | bsd-4 | spdx | {E}bsd 4 clause
1 | isc | spdx | {E}isc
1 | x11 | spdx | {E}x11
1 | zlib | spdx | {E}zlib
1 | libpng | spdx | {E}libpng(?: 2 0)?
1 | gpl-1 | spdx | {E}gpl 1 0(?: only| or later)?
1 | gpl-2 | spdx | {E}gpl 2 0(?: only| or later)?
1 | gpl-3 | spdx | {E}gpl 3 0(?: only| or later)?
1 | lgpl-2 | spdx | {E}lgpl 2 [01](?: only| or later)?
1 | lgpl-3 | spdx | {E}lgpl 3 0(?: only| or later)?
1 | agpl-3 | spdx | {E}agpl 3 0(?: only| or later)?
1 | gfdl | spdx | {E}gfdl 1 [123](?: only| or later)?
1 | mpl-1 | spdx | {E}mpl 1 [01]
1 | mpl-2 | spdx | {E}mpl 2 0
1 | epl-1 | spdx | {E}epl 1 0
1 | epl-2 | spdx | {E}epl 2 0
1 | eupl | spdx | {E}eupl 1 [012]
1 | cddl | spdx | {E}cddl 1 [01]
1 | cpl | spdx | {E}cpl 1 0
1 | cc0 | spdx | {E}cc0 1 0
1 | cc-by | spdx | {E}cc by [1-4] [05]
1 | cc-by-sa | spdx | {E}cc by sa [1-4] [05]
1 | cc-by-nd | spdx | {E}cc by nd [1-4] [05]
1 | cc-by-nc | spdx | {E}cc by nc [1-4] [05]
1 | cc-by-nc-sa | spdx | {E}cc by nc sa [1-4] [05]
1 | cc-by-nc-nd | spdx | {E}cc by nc nd [1-4] [05]
1 | bsl | spdx | {E}bsl 1 0
1 | ncsa | spdx | {E}ncsa
1 | python | spdx | {E}(?:psf|python) 2 0
1 | postgresql | spdx | {E}postgresql
1 | php | spdx | {E}php 3 0[01]?
1 | artistic | spdx | {E}artistic 1 0
1 | artistic-2 | spdx | {E}artistic 2 0
1 | openssl | spdx | {E}openssl
1 | ofl | spdx | {E}ofl 1 [01]
1 | osl | spdx | {E}osl 3 0
1 | odbl | spdx | {E}odbl 1 0
1 | unlicense | spdx | {E}unlicense
1 | wtfpl | spdx | {E}wtfpl
1 | sspl | spdx | {E}sspl 1 0
1 | busl | spdx | {E}busl 1 1
1 | ms-pl | spdx | {E}ms pl
1 | ms-rl | spdx | {E}ms rl
1 | ruby | spdx | {E}ruby
2 | mit | mit | (?:under|by|with|to) (?:the )?(?:terms of the )?(?:mit|expat|mit expat)(?: style| x11)? {L}
2 | mit | mit | {L}d? ?: ?mit
2 | mit | licen | {L} (?:is )?mit
2 | bsd | bsd | (?:under|by|with|to) (?:the |a )?(?:terms of the )?bsd(?: style)? {L}
2 | gpl | gpl | (?:under|by) (?:the )?(?:terms of the )?(?:gnu )?gpl
2 | lgpl | lgpl | (?:under|by) (?:the )?(?:terms of the )?(?:gnu )?lgpl
2 | agpl | agpl | (?:under|by) (?:the )?(?:terms of the )?(?:gnu )?agpl
2 | isc | isc | (?:under|by) (?:the )?(?:terms of the )?isc {L}
2 | apache | apache | (?:under|by) (?:the )?(?:terms of the )?apache(?: software)? {L}
2 | cc-by | cc by | (?:under|by) (?:a |the )?(?:creative commons )?cc by(?: [1-4] [05])?(?: international| unported)?(?! (?:nc|nd|sa))
2 | public-domain | public domain | (?:released|dedicated|placed|donated) (?:in|in to|into|to) the public domain
2 | proprietary | proprietary | (?:under|subject to|governed by) (?:a |an |the )?(?:[a-z0-9]+ )?proprietary(?: software)? {L}
2 | proprietary | rights reserved | all rights reserved (?:unauthori[sz]ed (?:copying|use)|no part of)
2 | proprietary | confidential | proprietary and confidential unauthori[sz]ed (?:copying|use|distribution)
2 | unlicense | unlicense | (?:under|by|see) (?:the )?unlicense
2 | wtfpl | wtfpl | (?:under|by) (?:the )?wtfpl
2 | zlib | zlib | (?:under|by) (?:the )?(?:terms of the )?zlib(?: libpng)? {L}
2 | odbl | odbl | (?:under|by) (?:the )?odbl
3 | apache-1 | apache | apache(?: software)?{V}1(?: [01])?
3 | apache-2 | apache | apache(?: software)?{V}2(?: 0)?
3 | apache-2 | asl | asl ?2 0
3 | gpl-1 | general public | (?:gnu )?general public {L}{V}1(?: 0)?{LATER}
3 | gpl-2 | general public | (?:gnu )?general public {L}{V}2(?: 0)?{LATER}
3 | gpl-3 | general public | (?:gnu )?general public {L}{V}3(?: 0)?{LATER}
3 | gpl-1 | gpl | (?:gnu )?gpl(?: version| v)? ?1(?: 0)?{LATER}
3 | gpl-2 | gpl | (?:gnu )?gpl(?: version| v|v)? ?2(?: 0)?{LATER}
3 | gpl-3 | gpl | (?:gnu )?gpl(?: version| v|v)? ?3(?: 0)?{LATER}
3 | lgpl-2 | general public | (?:gnu )?(?:lesser|library) general public {L}{V}2(?: [01])?{LATER}
3 | lgpl-3 | general public | (?:gnu )?lesser general public {L}{V}3(?: 0)?{LATER}
3 | lgpl-2 | lgpl | (?:gnu )?lgpl(?: version| v|v)? ?2(?: [01])?{LATER}
3 | lgpl-3 | lgpl | (?:gnu )?lgpl(?: version| v|v)? ?3(?: 0)?{LATER}
3 | agpl-3 | affero | (?:gnu )?affero general public {L}{V}3(?: 0)?{LATER}
3 | agpl-3 | agpl | (?:gnu )?agpl(?: version| v|v)? ?3(?: 0)?{LATER}
3 | gfdl | free documentation | (?:gnu )?free documentation {L}{V}1 [123]
3 | gfdl | gfdl | gfdl(?: version| v)? ?1 [123]
3 | bsd-0 | bsd | (?:0|zero) clause bsd(?: {L})?
3 | bsd-0 | bsd | bsd (?:0|zero) clause(?: {L})?
3 | bsd-0 | 0bsd | 0bsd(?: {L})?
3 | bsd-2 | bsd | (?:2|two) clause bsd(?: {L})?
3 | bsd-2 | bsd | bsd (?:2|two) clause(?: {L})?
3 | bsd-2 | bsd | (?:simplified bsd|freebsd) {L}
3 | bsd-3 | bsd | (?:3|three) clause bsd(?: {L})?
3 | bsd-3 | bsd | bsd (?:3|three) clause(?: {L})?
3 | bsd-3 | bsd | (?:new|revised|modified) bsd {L}
3 | bsd-4 | bsd | (?:4|four) clause bsd(?: {L})?
3 | bsd-4 | bsd | bsd (?:4|four) clause(?: {L})?
3 | bsd-4 | bsd | (?:original|old) bsd {L}
3 | mpl-1 | mozilla | mozilla public {L}{V}1(?: [01])?
3 | mpl-2 | mozilla | mozilla public {L}{V}2(?: 0)?
3 | mpl-1 | mpl | mpl(?: version| v|v)? ?1(?: [01])?
3 | mpl-2 | mpl | mpl(?: version| v|v)? ?2(?: 0)?
3 | epl-1 | eclipse | eclipse public {L}{V}1(?: 0)?
3 | epl-2 | eclipse | eclipse public {L}{V}2(?: 0)?
3 | epl-1 | epl | epl(?: version| v|v)? ?1(?: 0)?
3 | epl-2 | epl | epl(?: version| v|v)? ?2(?: 0)?
3 | eupl | eupl | eupl(?: version| v|v)? ?1(?: [012])?
3 | eupl | european union | european union public {L}(?:{V}1(?: [012])?)?
3 | cddl | cddl | cddl(?: version| v|v)? ?1(?: [01])?
3 | cddl | common development | common development and distribution {L}(?:{V}1(?: [01])?)?
3 | artistic-2 | artistic | artistic {L}{V}2(?: 0)?
3 | bsl | boost | boost software {L}(?:{V}1 0)?
3 | cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
3 | cc0 | creative commons | creative commons(?: cc0)? zero(?: v ?1 0| 1 0)?(?: universal)?
3 | cc-by-nc-nd | cc by | cc by nc nd(?: [1-4] [05])?
3 | cc-by-nc-sa | cc by | cc by nc sa(?: [1-4] [05])?
3 | cc-by-nc | cc by | cc by nc(?: [1-4] [05])?
3 | cc-by-nd | cc by | cc by nd(?: [1-4] [05])?
3 | cc-by-sa | cc by | cc by sa(?: [1-4] [05])?
3 | cc-by | cc by | cc by [1-4] [05]
3 | cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
3 | cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
3 | cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?
3 | cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
3 | cc-by-sa | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?
3 | cc-by | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported)?
3 | ofl | open font | (?:sil )?open font {L}(?:{V}1 [01])?
3 | osl | open software | open software {L}(?:{V}3 0)?
3 | odbl | open database | open database {L}
3 | sspl | server side | server side public {L}
3 | python | python | python software foundation {L}
3 | php | php | php {L}(?:{V}3 0[01]?)?
3 | ms-pl | microsoft | microsoft public {L}
3 | ms-rl | microsoft | microsoft reciprocal {L}
3 | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? {L}
4 | mit | mit | (?:mit|expat)(?: x11| style)? {L}
4 | apache | apache | apache(?: software)? {L}
4 | agpl | affero | (?:gnu )?affero general public {L}
4 | lgpl | general public | (?:gnu )?(?:lesser|library) general public {L}
4 | gpl | general public | (?:gnu )?general public {L}
4 | agpl | agpl | agpl {L}
4 | lgpl | lgpl | lgpl {L}
4 | gpl | gpl | (?:gnu gpl|gpl {L})
4 | gfdl | free documentation | (?:gnu )?free documentation {L}
4 | bsd | bsd | bsd(?: style)? {L}
4 | mpl | mozilla | mozilla public {L}
4 | epl | eclipse | eclipse public {L}
4 | cpl | common public | common public {L}
4 | artistic | artistic | artistic {L}
4 | cc | creative commons | creative commons {L}
4 | isc | isc | isc {L}
4 | x11 | x11 | x11 {L}
4 | zlib | zlib | zlib(?: libpng)? {L}
4 | libpng | libpng | libpng {L}
4 | openssl | openssl | openssl {L}
4 | postgresql | postgresql | postgresql {L}
4 | ruby | ruby | ruby {L}
4 | perl | perl | perl {L}
4 | vim | vim | vim {L}
4 | json | json | json {L}
4 | beerware | beer | beer ?ware {L}
4 | unlicense | unlicense | the unlicense
4 | wtfpl | wtfpl | wtfpl(?: {L})?
4 | proprietary | proprietary | proprietary(?: software)? {L}
"""
#: The confidence of each priority.
CONFIDENCE = [1.0, 0.95, 0.8, 0.6]
#: Matches that positions are summed over at a time.
BLOCK = 500
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules(source: str = RULES) -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) in order."""
    out = []
    for line in source.strip().splitlines():
        priority, label, keyword, pattern = line.split(" | ", 3)
        for short, long in SHORT.items():
            pattern = pattern.replace(short, long)
        out.append((int(priority), label, keyword, f"(?<= )(?:{pattern})(?= )"))
    return out


def blanks(c: F.Column) -> F.Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def let(value: F.Column, use) -> F.Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def prefixed(items: F.Column) -> F.Column:
    """(start, end) of the items (gap before, length) that follow each other, summed in blocks, then over blocks. Its argument is
    a variable: what stands in a lambda is computed again for each element."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: F.Column, x: F.Column) -> F.Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    inner = F.transform(blocks, lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def joined(inner: F.Column) -> F.Column:
        base = F.aggregate(inner, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                           lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(inner, base, lambda x, b: F.transform(x["out"], lambda o: F.struct((o["s"] + b).alias("s"), (o["e"] + b).alias("e")))))

    return let(inner, joined)


def intervals(text: F.Column, rule: F.Column) -> F.Column:
    """The matches of a rule as (start, longer first, priority, number, label)."""
    pieces = let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda found: F.zip_with(
        F.slice(F.split(text, rule["pattern"], -1), 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))))
    spans = let(pieces, prefixed)
    return F.transform(spans, lambda o: F.struct(o["s"].alias("start"), (-o["e"]).alias("minus_end"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label")))


def resolved(detections: F.Column) -> F.Column:
    """labels and best (the smallest priority) of the detections that aren't suppressed.

    They come in order of their start, the longer first: one lies inside another before it if that ends as late. For each
    priority the last end so far is kept, so each detection is compared with a few numbers."""
    none = F.struct(F.array(*[F.lit(-1)] * len(CONFIDENCE)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(99).alias("best"))

    def step(acc: F.Column, d: F.Column) -> F.Column:
        end = -d["minus_end"]
        covered = F.array_max(F.slice(acc["ends"], 1, d["priority"])) >= end
        ends = F.transform(acc["ends"], lambda x, i: F.when(i + 1 == d["priority"], F.greatest(x, end)).otherwise(x))
        labels = F.when(covered, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        return F.struct(ends.alias("ends"), labels.alias("labels"), F.when(covered, acc["best"]).otherwise(F.least(acc["best"], d["priority"])).alias("best"))

    return F.aggregate(F.array_sort(detections), none, step)


def detected(text: F.Column, made: list[tuple[int, str, str, str]]) -> F.Column:
    """All matches of the rules whose keyword the text holds, at the start of a word."""
    row = lambda i, r: F.struct(F.lit(r[0]).alias("priority"), F.lit(i).alias("number"), F.lit(r[1]).alias("label"), F.lit(f" {r[2]}").alias("keyword"), F.lit(r[3]).alias("pattern"))
    every = F.array(*[row(i, r) for i, r in enumerate(made)])
    asked = F.filter(F.filter(every, lambda r: F.contains(text, r["keyword"])), lambda r: F.regexp_like(text, r["pattern"]))
    return F.flatten(F.transform(asked, lambda r: intervals(text, r)))


def scan(docs: DataFrame, carry: list[str], source: str = RULES) -> DataFrame:
    """The columns `carry`, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    made = rules(source)
    text = F.coalesce("text", F.lit(""))
    words = sorted({"licen" if "{L}" in line else keyword for line, (_, _, keyword, _) in zip(source.strip().splitlines(), made, strict=True)} | {p for p, _ in PHRASES})
    gate = f"(?i)(?<!{WORD})(?:{'|'.join(words)})".replace(" ", BETWEEN)
    lowered = F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " ")
    rows = docs.select(*carry, F.regexp_count(text, F.lit(f"{WORD}++")).cast("long").alias("n_words"), F.when(text.rlike(gate), F.concat(F.lit(" "), F.trim(lowered), F.lit(" "))).alias("__norm"))
    count, first, last, base = F.lit(0).cast("long"), [], [], []
    for i, (phrase, label) in enumerate(PHRASES):
        rows = rows.withColumn(f"__parts{i}", F.split("__norm", f" {phrase}(?= )"))
        parts, found = F.col(f"__parts{i}"), F.coalesce(F.size(f"__parts{i}") > 1, F.lit(False))
        count = count + F.when(found, F.size(parts) - 1).otherwise(0)
        first.append(F.when(found, blanks(F.get(parts, 0))))
        rest = blanks(F.element_at(parts, -1)) - 1
        last.append(F.when(found, F.col("n_words") - rest - len(phrase.split())))
        base.append(F.when(found, F.lit(label)))
    rows = rows.withColumn("__own", F.when(F.col("__norm").isNotNull(), resolved(detected(F.col("__norm"), made))))
    own, best = F.coalesce("__own.labels", F.array().cast("array<string>")), F.coalesce("__own.best", F.lit(99))
    score = F.lit(0.0)
    for k, confidence in enumerate(CONFIDENCE, 1):
        score = F.when(best == k, confidence).otherwise(score)
    base_labels = F.array_sort(F.array_compact(F.array(*base)))
    least = lambda parts, pick: pick(F.array(*[p.cast("long") for p in parts]))
    return rows.select(
        *carry, "n_words", count.alias("n_base"), least(first, F.array_min).alias("first_word"), least(last, F.array_max).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(score).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
