"""Signature rules of the license scan, most telling kind first.

A rule is a line ``label | expression``, matched against folded text: lower case, and each run of
white space and comment signs one space. ``LIC`` stands for either spelling of license, ``VER`` for
an optional version, ``UNDER`` for a word of granting with its preposition, ``END`` for the end of a
word. Of two rules that match the same interval the earlier one counts.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

MACROS = {
    "LIC": "licen[cs]e",
    "VER": r"(?:,? ?(?:version |v\.? ?)?[0-9](?:\.[0-9]){0,2}(?![0-9]))?",
    "UNDER": r"(?:under|(?:covered|governed|licensed|licenced) (?:by|with|to)|accordance with|terms of|conditions of) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?",
    "END": "(?![a-z0-9])",
}

#: Kinds of rules: their strength, and the rules.
KINDS = (
    # the identifier that a file declares
    (1.0, r"""
        mit | spdx-LIC-identifier: ?mitEND(?!-)
        mit-0 | spdx-LIC-identifier: ?mit-0END
        x11 | spdx-LIC-identifier: ?x11END
        apache | spdx-LIC-identifier: ?apache-[0-9.]{1,4}
        bsd | spdx-LIC-identifier: ?bsd-[1-4]-clause
        0bsd | spdx-LIC-identifier: ?0bsdEND
        isc | spdx-LIC-identifier: ?iscEND
        gpl | spdx-LIC-identifier: ?gpl-[0-9.]{1,4}(?:-only|-or-later|\+)?
        lgpl | spdx-LIC-identifier: ?lgpl-[0-9.]{1,4}(?:-only|-or-later|\+)?
        agpl | spdx-LIC-identifier: ?agpl-[0-9.]{1,4}(?:-only|-or-later|\+)?
        gfdl | spdx-LIC-identifier: ?gfdl-[0-9.]{1,4}
        mpl | spdx-LIC-identifier: ?mpl-[0-9.]{1,4}
        epl | spdx-LIC-identifier: ?epl-[0-9.]{1,4}
        cddl | spdx-LIC-identifier: ?cddl-[0-9.]{1,4}
        cpl | spdx-LIC-identifier: ?cpl-[0-9.]{1,4}
        eupl | spdx-LIC-identifier: ?eupl-[0-9.]{1,4}
        cecill | spdx-LIC-identifier: ?cecill-[0-9a-c.]{1,4}
        cc0 | spdx-LIC-identifier: ?cc0-[0-9.]{1,4}
        cc-by-nc-sa | spdx-LIC-identifier: ?cc-by-nc-sa-[0-9.]{1,4}
        cc-by-nc-nd | spdx-LIC-identifier: ?cc-by-nc-nd-[0-9.]{1,4}
        cc-by-nc | spdx-LIC-identifier: ?cc-by-nc-[0-9.]{1,4}
        cc-by-sa | spdx-LIC-identifier: ?cc-by-sa-[0-9.]{1,4}
        cc-by-nd | spdx-LIC-identifier: ?cc-by-nd-[0-9.]{1,4}
        cc-by | spdx-LIC-identifier: ?cc-by-[0-9.]{1,4}
        unlicense | spdx-LIC-identifier: ?unlicenseEND
        wtfpl | spdx-LIC-identifier: ?wtfplEND
        zlib | spdx-LIC-identifier: ?zlibEND
        bsl | spdx-LIC-identifier: ?bsl-[0-9.]{1,4}
        artistic | spdx-LIC-identifier: ?artistic-[0-9.]{1,4}
        python | spdx-LIC-identifier: ?(?:psf|python)-[0-9.]{1,4}
        ofl | spdx-LIC-identifier: ?ofl-[0-9.]{1,4}
        odbl | spdx-LIC-identifier: ?odbl-[0-9.]{1,4}
        busl | spdx-LIC-identifier: ?busl-[0-9.]{1,4}
        sspl | spdx-LIC-identifier: ?sspl-[0-9.]{1,4}
        ms-pl | spdx-LIC-identifier: ?ms-plEND
        postgresql | spdx-LIC-identifier: ?postgresqlEND
        openssl | spdx-LIC-identifier: ?opensslEND
        elastic | spdx-LIC-identifier: ?elastic-[0-9.]{1,4}
    """),
    # sentences of the texts themselves
    (0.95, r"""
        mit | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        mit | to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish
        mit | the software is provided ["']?as is["']?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
        x11 | except as contained in this notice, the name of the x consortium shall not be used in advertising
        bsd | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
        bsd | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
        bsd | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        bsd | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
        bsd | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
        bsd | this software is provided by the (?:copyright holders and contributors|regents and contributors|author) ["']?as is["']? and any express or implied warranties
        isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
        isc | the software is provided ["']?as is["']? and the author disclaims all warranties with regard to this software
        apache | licensed under the apache LIC, version 2\.0 \(the ["']LIC["']\)
        apache | you may not use this file except in compliance with the LIC
        apache | unless required by applicable law or agreed to in writing, software distributed under the LIC is distributed on an ["']as is["'] basis
        apache | subject to the terms and conditions of this LIC, each contributor hereby grants to you a perpetual, worldwide, non-exclusive
        gpl | is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public LIC
        lgpl | is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public LIC
        agpl | is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu affero general public LIC
        gpl | you should have received a copy of the gnu general public LIC along with this
        lgpl | you should have received a copy of the gnu (?:lesser|library) general public LIC along with this
        agpl | you should have received a copy of the gnu affero general public LIC along with this
        gpl | the licenses for most software are designed to take away your freedom to share and change it
        gpl | this general public LIC does not permit incorporating your program into proprietary programs
        gfdl | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation LIC
        mpl | this source code form is subject to the terms of the mozilla public LIC
        mpl | the contents of this file are subject to the mozilla public LIC
        mpl | if a copy of the mpl was not distributed with this file, you can obtain one at
        epl | this program and the accompanying materials are made available under the terms of the eclipse public LIC
        edl | this program and the accompanying materials are made available under the terms of the eclipse distribution LIC
        cddl | the contents of this file are subject to the terms of the common development and distribution LIC
        cpl | the accompanying program is provided under the terms of this common public LIC
        eupl | licensed under the eupl, (?:version|v)\.? ?1\.[12]
        cecill | this software is governed by the cecill(?:-[bc])? LIC
        unlicense | this is free and unencumbered software released into the public domain
        unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
        cc0 | to the extent possible under law, .{1,80}? has waived all copyright and related or neighboring rights
        wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this LIC document, and changing it is allowed as long as the name is changed
        wtfpl | you just do what the .{1,8}? you want to
        zlib | this software is provided ["']as-is["'], without any express or implied warranty
        zlib | the origin of this software must not be misrepresented; you must not claim that you wrote the original software
        zlib | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
        bsl | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this LIC
        artistic | you may make and give away verbatim copies of the source form of the standard version of this package
        artistic | the intent of this document is to state the conditions under which a package may be copied
        python | the python software foundation \(["']psf["']\)
        python | this LIC agreement is between the python software foundation
        ofl | this font software is licensed under the sil open font LIC
        ofl | the ofl allows the licensed fonts to be used, studied, modified and redistributed freely
        openssl | this product includes software developed by the openssl project
        postgresql | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
        ms-pl | if you use the software, you accept this LIC\. if you do not accept the LIC, do not use the software
        busl | the business source LIC \(this document, or the ["']LIC["']\) is not an open source LIC
        sspl | if you make the functionality of the program or a modified version available to third parties as a service
        elastic | you may not provide the software to third parties as a hosted or managed service
        curl | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        beerware | if we meet some day, and you think this stuff is worth it, you can buy me a beer in return
        json | the software shall be used for good, not evil
        ncsa | permission is hereby granted, free of charge, to any person obtaining a copy of this software .{1,80}? to deal with the software without restriction
        unicode | unicode data files or software .{0,120}? without restriction
        ruby | you may redistribute your version of the software in any of the ways
        vim | there are no restrictions on distributing unmodified copies of vim
    """),
    # what something is granted under
    (0.9, r"""
        mit | UNDERmit(?: ?/ ?x11|/expat)?(?:-style| style)?(?: LIC)?END(?! no attribution)
        mit | UNDERexpat(?: LIC)?END
        mit-0 | UNDERmit(?:-0| no attribution)(?: LIC)?END
        x11 | UNDERx11 LICEND
        apache | UNDERapache(?: software)?(?: LIC)?VEREND
        apache | UNDERasl ?2(?:\.0)?END
        bsd | UNDER(?:new |modified |revised |simplified |original |(?:two|three|four|[234])-clause )?bsd(?:[ -][0-9]-clause)?(?:-style| style)?(?: LIC)?END
        0bsd | UNDER(?:zero|0)[ -]clause bsd(?: LIC)?END
        isc | UNDERisc(?: LIC)END
        gpl | UNDER(?:gnu )?gpl(?: LIC)?VER(?:\+| or later| only)?END
        gpl | UNDER(?:gnu )?general public LICVEREND
        lgpl | UNDER(?:gnu )?lgpl(?: LIC)?VER(?:\+| or later| only)?END
        lgpl | UNDER(?:gnu )?(?:lesser|library) (?:gpl|general public LIC)VEREND
        agpl | UNDER(?:gnu )?agpl(?: LIC)?VER(?:\+| or later| only)?END
        agpl | UNDER(?:gnu )?affero (?:gpl|general public LIC)VEREND
        gfdl | UNDER(?:gnu free documentation LIC|gfdl)VEREND
        mpl | UNDER(?:mozilla public LIC|mpl)VEREND
        epl | UNDER(?:eclipse public LIC|epl)VEREND
        cddl | UNDER(?:common development and distribution LIC|cddl)VEREND
        eupl | UNDER(?:european union public LIC|eupl)VEREND
        cc-by-nc-sa | UNDER(?:creative commons|cc)[ -](?:by[ -]nc[ -]sa|attribution[ -]non-?commercial[ -]share-?alike)
        cc-by-nc-nd | UNDER(?:creative commons|cc)[ -](?:by[ -]nc[ -]nd|attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?)
        cc-by-nc | UNDER(?:creative commons|cc)[ -](?:by[ -]nc|attribution[ -]non-?commercial)END
        cc-by-sa | UNDER(?:creative commons|cc)[ -](?:by[ -]sa|attribution[ -]share-?alike)END
        cc-by-nd | UNDER(?:creative commons|cc)[ -](?:by[ -]nd|attribution[ -]no-?deriv(?:ative)?s?)END
        cc-by | UNDER(?:creative commons|cc)[ -](?:by|attribution)VEREND
        cc0 | UNDER(?:creative commons )?cc0END
        unlicense | UNDERunlicenseEND
        wtfpl | UNDERwtfplEND
        zlib | UNDERzlib(?:/libpng)?(?: LIC)?END
        bsl | UNDERboost(?: software)? LICVEREND
        artistic | UNDER(?:perl )?artistic LICVEREND
        python | UNDER(?:python software foundation|psf|python) LICVEREND
        ofl | UNDER(?:sil )?(?:open font LIC|ofl)VEREND
        odbl | UNDER(?:open database LIC|odbl)VEREND
        busl | UNDER(?:business source LIC|busl)VEREND
        sspl | UNDER(?:server side public LIC|sspl)VEREND
        elastic | UNDERelastic LICVEREND
        perl | UNDERsame terms as perl(?: itself)?
        ruby | UNDERsame terms as ruby(?: itself)?
        public-domain | (?:released|dedicated|placed) (?:in|to|into) the public domain
        proprietary | UNDER(?:a )?(?:proprietary|commercial) LIC
    """),
    # links to the texts
    (0.85, r"""
        mit | opensource\.org/licenses?/mitEND
        mit | choosealicense\.com/licenses/mitEND
        bsd | opensource\.org/licenses?/bsd-[0-9]-clause
        isc | opensource\.org/licenses?/iscEND
        apache | apache\.org/licenses/license-2\.0
        apache | opensource\.org/licenses?/apache-2\.0
        gpl | gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?gpl(?:-[0-9.]{1,4})?END
        lgpl | gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?(?:lgpl|lesser)(?:-[0-9.]{1,4})?END
        agpl | gnu\.org/licenses/agpl(?:-[0-9.]{1,4})?END
        gfdl | gnu\.org/(?:copyleft|licenses)/fdl(?:-[0-9.]{1,4})?END
        gpl | opensource\.org/licenses?/gpl-
        lgpl | opensource\.org/licenses?/lgpl-
        mpl | mozilla\.org/(?:en-us/)?mpl(?:/[0-9.]{1,4})?
        epl | eclipse\.org/legal/epl-(?:v10|2\.0|v20)
        cc0 | creativecommons\.org/publicdomain/zero/
        public-domain | creativecommons\.org/publicdomain/mark/
        cc-by-nc-sa | creativecommons\.org/licenses/by-nc-sa/
        cc-by-nc-nd | creativecommons\.org/licenses/by-nc-nd/
        cc-by-nc | creativecommons\.org/licenses/by-nc/
        cc-by-sa | creativecommons\.org/licenses/by-sa/
        cc-by-nd | creativecommons\.org/licenses/by-nd/
        cc-by | creativecommons\.org/licenses/by/
        unlicense | unlicense\.org
        wtfpl | wtfpl\.net
        bsl | boost\.org/license_1_0\.txt
        zlib | zlib\.net/zlib_license
        ofl | scripts\.sil\.org/ofl
        artistic | perlfoundation\.org/artistic_license_
        odbl | opendatacommons\.org/licenses/odbl
        pddl | opendatacommons\.org/licenses/pddl
        eupl | joinup\.ec\.europa\.eu/.{0,60}?eupl
        busl | mariadb\.com/bsl
    """),
    # names of licenses
    (0.6, r"""
        mit | (?<![a-z0-9])mit LICEND
        mit | (?<![a-z0-9])mit/x11 LICEND
        mit | (?<![a-z0-9])expat LICEND
        mit-0 | (?<![a-z0-9])mit no attribution LICEND
        x11 | (?<![a-z0-9])x11 LICEND
        apache | (?<![a-z0-9])apache(?: software)? LICVEREND
        apache | (?<![a-z0-9])apache(?:-| )2\.0END
        bsd | (?<![a-z0-9])bsd(?:-style| style)? LICEND
        bsd | (?<![a-z0-9])bsd[ -][1-4][ -]clause(?: LIC)?END
        bsd | (?<![a-z0-9])(?:two|three|four|[1-4])[ -]clause bsd(?: LIC)?END
        bsd | (?<![a-z0-9])(?:new|modified|revised|simplified|original) bsd(?: LIC)?END
        0bsd | (?<![a-z0-9])(?:zero|0)[ -]clause bsd(?: LIC)?END
        isc | (?<![a-z0-9])isc LICEND
        gpl | (?<![a-z0-9])(?:gnu )?general public LICVEREND
        gpl | (?<![a-z0-9])gnu gplVEREND
        gpl | (?<![a-z0-9])gpl(?:,? version |[ -]?v?\.? ?)[123](?:\.0)?(?:\+|-only|-or-later)?END
        gpl | (?<![a-z0-9])gpl LICEND
        lgpl | (?<![a-z0-9])(?:gnu )?(?:lesser|library) general public LICVEREND
        lgpl | (?<![a-z0-9])(?:gnu )?(?:lesser|library) gplVEREND
        lgpl | (?<![a-z0-9])lgpl(?:,? version |[ -]?v?\.? ?)[23](?:\.[01])?(?:\+|-only|-or-later)?END
        lgpl | (?<![a-z0-9])lgpl LICEND
        agpl | (?<![a-z0-9])(?:gnu )?affero general public LICVEREND
        agpl | (?<![a-z0-9])(?:gnu )?affero gplVEREND
        agpl | (?<![a-z0-9])agpl(?:,? version |[ -]?v?\.? ?)[13](?:\.0)?(?:\+|-only|-or-later)?END
        agpl | (?<![a-z0-9])agpl LICEND
        gfdl | (?<![a-z0-9])(?:gnu )?free documentation LICVEREND
        mpl | (?<![a-z0-9])mozilla public LICVEREND
        mpl | (?<![a-z0-9])mpl[ -]?v?[12]\.[0-9]END
        npl | (?<![a-z0-9])netscape public LICVEREND
        epl | (?<![a-z0-9])eclipse public LICVEREND
        epl | (?<![a-z0-9])epl[ -]?v?[12]\.[0-9]END
        edl | (?<![a-z0-9])eclipse distribution LICVEREND
        cddl | (?<![a-z0-9])common development and distribution LICVEREND
        cpl | (?<![a-z0-9])common public LICVEREND
        cpal | (?<![a-z0-9])common public attribution LICVEREND
        ipl | (?<![a-z0-9])ibm public LICVEREND
        osl | (?<![a-z0-9])open software LICVEREND
        afl | (?<![a-z0-9])academic free LICVEREND
        qpl | (?<![a-z0-9])q public LICVEREND
        eupl | (?<![a-z0-9])european union public LICVEREND
        cecill | (?<![a-z0-9])cecill(?:-[bc])? LICVEREND
        cc-by-nc-sa | (?<![a-z0-9])(?:creative commons|cc)[ -]by[ -]nc[ -]saVEREND
        cc-by-nc-nd | (?<![a-z0-9])(?:creative commons|cc)[ -]by[ -]nc[ -]ndVEREND
        cc-by-nc | (?<![a-z0-9])(?:creative commons|cc)[ -]by[ -]ncVEREND
        cc-by-sa | (?<![a-z0-9])(?:creative commons|cc)[ -]by[ -]saVEREND
        cc-by-nd | (?<![a-z0-9])(?:creative commons|cc)[ -]by[ -]ndVEREND
        cc-by | (?<![a-z0-9])(?:creative commons|cc)[ -]byVEREND
        cc-by-nc-sa | (?<![a-z0-9])attribution[ -]non-?commercial[ -]share-?alikeVEREND
        cc-by-nc-nd | (?<![a-z0-9])attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?VEREND
        cc-by-nc | (?<![a-z0-9])attribution[ -]non-?commercialVEREND
        cc-by-sa | (?<![a-z0-9])attribution[ -]share-?alikeVEREND
        cc-by | (?<![a-z0-9])creative commons attributionVEREND
        cc0 | (?<![a-z0-9])cc0(?:[ -]1\.0| universal| LIC| public domain dedication)END
        unlicense | (?<![a-z0-9])the unlicenseEND
        wtfpl | (?<![a-z0-9])do what the .{1,8}? you want to public LIC
        wtfpl | (?<![a-z0-9])wtfpl(?: LIC|,? version 2|v2)END
        zlib | (?<![a-z0-9])zlib(?:/libpng)? LICEND
        bsl | (?<![a-z0-9])boost software LICVEREND
        artistic | (?<![a-z0-9])artistic LICVEREND
        python | (?<![a-z0-9])python software foundation LICVEREND
        python | (?<![a-z0-9])psf LICVEREND
        ofl | (?<![a-z0-9])(?:sil )?open font LICVEREND
        odbl | (?<![a-z0-9])open database LICVEREND
        odbl | (?<![a-z0-9])open data commons open database LICVEREND
        odc-by | (?<![a-z0-9])open data commons attribution LICVEREND
        pddl | (?<![a-z0-9])public domain dedication and LICVEREND
        openssl | (?<![a-z0-9])openssl LICEND
        postgresql | (?<![a-z0-9])postgresql LICEND
        php | (?<![a-z0-9])php LICVEREND
        ruby | (?<![a-z0-9])ruby LICEND
        vim | (?<![a-z0-9])vim LICEND
        curl | (?<![a-z0-9])curl LICEND
        ncsa | (?<![a-z0-9])(?:university of illinois/)?ncsa(?: open source)? LICEND
        ms-pl | (?<![a-z0-9])microsoft public LICVEREND
        ms-rl | (?<![a-z0-9])microsoft reciprocal LICVEREND
        upl | (?<![a-z0-9])universal permissive LICVEREND
        busl | (?<![a-z0-9])business source LICVEREND
        elastic | (?<![a-z0-9])elastic LIC(?:VER| 2\.0)END
        sspl | (?<![a-z0-9])server side public LICVEREND
        bigscience | (?<![a-z0-9])(?:bigscience )?(?:open)?rail(?:-m)? LICEND
        open-government | (?<![a-z0-9])open government LICVEREND
        beerware | (?<![a-z0-9])beerware LICEND
        json | (?<![a-z0-9])json LICEND
        unicode | (?<![a-z0-9])unicode LIC agreement
        w3c | (?<![a-z0-9])w3c software(?: notice and)? LICEND
    """),
    # a declaration of a field, and words that only hint
    (0.5, r"""
        mit | (?<![a-z0-9])LIC ?[:=] ?["']?mitEND(?!-)
        apache | (?<![a-z0-9])LIC ?[:=] ?["']?apache
        bsd | (?<![a-z0-9])LIC ?[:=] ?["']?(?:bsd|(?:two|three|[23])-clause bsd)
        isc | (?<![a-z0-9])LIC ?[:=] ?["']?iscEND
        gpl | (?<![a-z0-9])LIC ?[:=] ?["']?(?:gnu )?gpl
        lgpl | (?<![a-z0-9])LIC ?[:=] ?["']?(?:gnu )?lgpl
        agpl | (?<![a-z0-9])LIC ?[:=] ?["']?(?:gnu )?agpl
        mpl | (?<![a-z0-9])LIC ?[:=] ?["']?mpl
        cc0 | (?<![a-z0-9])LIC ?[:=] ?["']?cc0
        unlicense | (?<![a-z0-9])LIC ?[:=] ?["']?(?:the )?unlicense
        proprietary | (?<![a-z0-9])LIC ?[:=] ?["']?(?:proprietary|commercial|unlicensed)
        public-domain | (?<![a-z0-9])(?:are|is|be) in the public domainEND
        proprietary | (?<![a-z0-9])all rights reservedEND
        proprietary | (?<![a-z0-9])proprietary and confidentialEND
        proprietary | (?<![a-z0-9])no part of this (?:publication|work|document) may be reproduced
    """),
)


def expand(text: str) -> str:
    for name, form in MACROS.items():
        text = text.replace(name, form)
    return text


def rules() -> list[tuple[int, float, str, str]]:
    """(order, strength, label, expression) of each rule."""
    lines = [(strength, *map(str.strip, line.split(" | ", 1))) for strength, block in KINDS for line in block.splitlines() if line.strip()]
    return [(i, strength, label, expand(form)) for i, (strength, label, form) in enumerate(lines)]


def _literals(tree) -> set[str] | None:
    """All strings that an expression without repeats matches, if they are few."""
    out = {""}
    for code, arg in tree:
        if code is op.LITERAL:
            more = {chr(arg)}
        elif code is op.IN and all(c is op.LITERAL for c, _ in arg):
            more = {chr(v) for _, v in arg}
        elif code is op.SUBPATTERN:
            more = _literals(arg[3])
        elif code is op.BRANCH:
            each = [_literals(branch) for branch in arg[1]]
            more = set().union(*each) if all(each) else None
        else:
            more = None
        if not more or len(out) * len(more) > 16:
            return None
        out = {a + b for a in out for b in more}
    return out


def _runs(tree) -> list[set[str]]:
    """Sets of strings, of each of which every match of the parsed expression holds one."""
    found: list[set[str]] = []
    run = {""}

    def close():
        nonlocal run
        if "" not in run:
            found.append(run)
        run = {""}

    for item in tree:
        more = _literals([item])
        if more and len(run) * len(more) <= 16:
            run = {a + b for a in run for b in more}
            continue
        close()
        code, arg = item
        if more:
            run = more
        elif code is op.SUBPATTERN:
            found += _runs(arg[3])
        elif code is op.BRANCH:
            best = [_best(_runs(branch)) for branch in arg[1]]
            if all(best):
                found.append(set().union(*best))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            found += _runs(arg[2])
    close()
    return found


def _best(runs: list[set[str]]) -> set[str]:
    """The most telling set: its shortest string is longest, without what all licenses share."""
    return max(runs, key=lambda r: (min(len(s.replace("licen", "").strip()) for s in r), -len(r)), default=set())


def keywords(expression: str) -> list[str]:
    """Strings of which every match holds one: read off the expression itself, so no match is lost by asking for them."""
    return sorted(_best(_runs(_parser.parse(expression))))


#: Words that the gate asks for where a rule allows it.
GATE_WORDS = ("licen", "under", "covered", "governed", "accordance", "terms", "conditions", "permi", "copies", "domain", "warrant", "redistribut", "software", "bsd", "gpl", "apache", "commons", "cc0", "attribution")


#: Stands for strings whose words are too short to ask for one.
BROKEN = "\x01"


def gates(table=None) -> tuple[list[set[str]], str]:
    """For each rule few words of which every match holds one; and an expression for what ``BROKEN`` stands for among them.

    Words hold no white space, so texts needn't be folded to ask for them.
    """
    chosen: set[str] = set()
    broken: set[str] = set()
    own = []
    for _, _, _, form in table or rules():
        runs, choices = _runs(_parser.parse(form)), []
        for run in runs:
            words = {next((g for g in GATE_WORDS if g in s), max(re.findall("[a-z0-9]+", s), key=len, default="")) for s in run}
            if min(map(len, words)) >= 3:
                choices.append(words)
        if choices:
            own.append(min(choices, key=lambda c: (len(c - set(GATE_WORDS)), len(c - chosen), len(c & {"licen", "under"}), -min(map(len, c)))))
            chosen |= own[-1]
        else:
            strings = _best(runs)
            known = {s: next((g for g in GATE_WORDS if g in s), None) for s in strings}
            own.append({g for g in known.values() if g} | {BROKEN})
            broken |= {"[^a-z0-9]+".join(re.findall("[a-z0-9]+", s)) for s in strings if not known[s]}
    return own, "|".join(sorted(s for s in broken if not any(s != o and s.startswith(o) for o in broken))) or "(?!)"


def plain(form: str) -> re.Pattern:
    """The expression for Python's own engine, for tests."""
    return re.compile(form, re.ASCII)
