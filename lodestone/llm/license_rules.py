"""Sentences of public licences with their identifiers, and ordered rules over these; normalised as ``licenses`` does.

Sentences of licence texts are written out, but for the GNU grant and the Creative Commons names, which are made by rule.
A reference to a licence is a head and a name; its identifier is the licence.
"""

from __future__ import annotations

# Names of licences, normalised.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit", "expat license", "mit expat license", "x11 license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache software license version 2 0", "apache software license 2 0", "apache 2 0", "apache 2 license", "apache license version 2 0 the license"],
    "Apache-1.1": ["apache software license version 1 1", "apache license version 1 1", "apache 1 1"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license version 2 0", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license version 3 0", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl version 2 1", "lgpl v2 1", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license version 3 0", "gnu lesser general public license v3", "gnu lgpl version 3", "lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license version 3 0", "gnu affero general public license v3", "gnu agpl version 3", "agpl version 3", "agpl v3", "agplv3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "GPL": ["gnu general public license", "gnu gpl", "gpl", "gpl license"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"],
    "AGPL": ["gnu affero general public license", "gnu agpl", "agpl"],
    "MPL-1.1": ["mozilla public license version 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl version 2 0", "mpl 2 0"],
    "MPL": ["mozilla public license", "mozilla public license v", "mpl"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl 1 0", "cddl version 1 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"],
    "BSD": ["bsd license", "bsd licence", "bsd style license", "bsd"],
    "ISC": ["isc license", "isc licence", "isc"],
    "Zlib": ["zlib license", "zlib libpng license", "zlib"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0", "artistic 2 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public licence 1 2", "european union public license version 1 2", "eupl v1 2", "eupl 1 2"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "ofl 1 1"],
    "PSF-2.0": ["python software foundation license version 2", "psf license version 2", "psf 2 0"],
    "Unlicense": ["unlicense", "the unlicense"],
    "WTFPL": ["do what the fuck you want to public license version 2", "do what the fuck you want to public license", "wtfpl version 2", "wtfpl"],
    "CC0-1.0": ["cc0 1 0 universal", "cc0 1 0 universal license", "cc0 1 0", "creative commons zero v1 0 universal", "creative commons zero 1 0", "cc0"],
}
# Creative Commons licences by their terms, and the words for them in names.
CC_TERMS = {
    "BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives",
    "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives",
}
CC_VERSIONS = {"2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}
#: What stands before a name, normalised.
HEAD = (
    r"^(?:(?:(?:this|the) (?:work|software|project|program|library|file|code|source code|package|document|text|content|dataset|material) is )?"
    r"(?:dual )?(?:licen[cs]ed|released|distributed|published|made available|available|provided) (?:under|subject to)(?: the terms(?: and conditions)? of)?"
    r"|(?:(?:the )?use of )?this (?:source code|software|code|file|package) is governed by|spdx license identifier|licen[cs]e) (?:either )?(?:of )?(?:the |an? )?"
)
#: Between names, and what may stand behind one: an exception, or where its text is.
JOINT = r" (?:and|or) (?:the |an? )?"
ASIDE = r" with [a-z0-9 ]*exception(?: [0-9 ]+)?| (?:that |which )?(?:can |may )?(?:be |is )?found in the licen[cs]e file.*$"
#: Words of names that are no joint.
WHOLE = {" or later": " orlater", "development and distribution": "development anddistribution"}
#: A name without anything before it must look like this.
ALONE = r"licen[cs]e|^cc by |^cc0 |^creative commons "

# Sentences of licence texts with their identifiers.
TEXTS = {
    "MIT:grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "MIT:notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    ],
    "MIT:warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement",
    ],
    "MIT:liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "Apache:compliance": [
        "you may not use this file except in compliance with the license",
        "you may not use this work except in compliance with the license",
        "you may not use these files except in compliance with the license",
    ],
    "Apache:copy": [
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    ],
    "Apache:basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "Apache:language": ["see the license for the specific language governing permissions and limitations under the license"],
    "Apache:notice": [
        "see the notice file distributed with this work for additional information regarding copyright ownership",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
    ],
    "GPL:free": [
        "this program is free software", "this library is free software", "this file is free software", "this package is free software", "this software is free software", "this project is free software", "this code is free software",
        "it is free software", "this is free software",
    ],
    "GPL:useful": [
        "this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty",
        "this file is distributed in the hope that it will be useful but without any warranty", "this package is distributed in the hope that it will be useful but without any warranty",
        "this software is distributed in the hope that it will be useful but without any warranty", "it is distributed in the hope that it will be useful but without any warranty",
    ],
    "GPL:implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL:details": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details", "see the gnu affero general public license for more details"],
    "GPL:received": [
        "you should have received a copy of the gnu general public license along with this program", "you should have received a copy of the gnu lesser general public license along with this program",
        "you should have received a copy of the gnu lesser general public license along with this library", "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "MPL-2.0:form": [
        "this source code form is subject to the terms of the mozilla public license v",  # what stands before "2.0" in "v. 2.0"
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license version 2 0",
    ],
    "MPL:copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "MPL-1.1:subject": ["the contents of this file are subject to the mozilla public license version 1 1 the license"],
    "EPL-1.0:made": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    ],
    "EPL-2.0:made": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    ],
    "BSD:redistribution": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted",
    ],
    "BSD:source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "BSD:binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "BSD:endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSD:warranty": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "ISC:grant": [
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "0BSD:grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "ISC:warranty": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "Zlib:warranty": ["this software is provided as is without any express or implied warranty"],
    "Zlib:grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "BSL-1.0:grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ],
    "Unlicense:released": ["this is free and unencumbered software released into the public domain"],
    "Unlicense:anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "Public-domain": ["this work is in the public domain", "this file is in the public domain", "this software is in the public domain", "released into the public domain", "this work has been released into the public domain", "placed in the public domain"],
    "All-rights-reserved": ["all rights reserved"],
}
# The GNU grant, whose families, versions and punctuation differ from text to text.
GNU = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2 1", "3")), "AGPL": ("gnu affero general public license", ("3",))}
GNU_TERMS = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
GNU_VERSIONS = ["either version {} of the license or at your option any later version", "version {} of the license", "either version {} of the license or at your option any later version of the license"]

# Rules in order of precedence, longer ones first: a licence and the identifiers that show it, one after another.
RULES = [
    ("MIT", ["MIT:grant", "MIT:notice", "MIT:warranty", "MIT:liability"]),
    ("MIT", ["MIT:grant", "MIT:notice", "MIT:warranty"]),
    ("Apache-2.0", ["Apache-2.0", "Apache:compliance", "Apache:copy", "Apache:basis", "Apache:language"]),
    ("Apache-2.0", ["Apache-2.0", "Apache:compliance", "Apache:copy"]),
    ("Apache-2.0", ["Apache-2.0", "Apache:compliance"]),
    ("BSD-3-Clause", ["BSD:redistribution", "BSD:source", "BSD:binary", "BSD:endorse", "BSD:warranty"]),
    ("BSD-3-Clause", ["BSD:redistribution", "BSD:source", "BSD:binary", "BSD:endorse"]),
    ("BSD-2-Clause", ["BSD:redistribution", "BSD:source", "BSD:binary", "BSD:warranty"]),
    ("BSD-2-Clause", ["BSD:redistribution", "BSD:source", "BSD:binary"]),
    ("ISC", ["ISC:grant", "ISC:warranty"]),
    ("ISC", ["ISC:grant"]),
    ("0BSD", ["0BSD:grant", "ISC:warranty"]),
    ("0BSD", ["0BSD:grant"]),
    ("Zlib", ["Zlib:warranty", "Zlib:grant"]),
    ("Zlib", ["Zlib:grant"]),
    ("BSL-1.0", ["BSL-1.0:grant"]),
    ("MPL-2.0", ["MPL-2.0:form", "MPL:copy"]),
    ("MPL-2.0", ["MPL-2.0:form"]),
    ("MPL-1.1", ["MPL-1.1:subject"]),
    ("EPL-2.0", ["EPL-2.0:made"]),
    ("EPL-1.0", ["EPL-1.0:made"]),
    ("Unlicense", ["Unlicense:released", "Unlicense:anyone"]),
    ("Unlicense", ["Unlicense:released"]),
    ("Public-domain", ["Public-domain"]),
]
#: After all others: reserving rights says nothing beside a licence's text, but is a result of its own.
LAST = [("All-rights-reserved", ["All-rights-reserved"])]


def names() -> dict[str, str]:
    """Normalised name to licence."""
    out = {name: key for key, every in NAMES.items() for name in every}
    out |= {f"{name} license": key for name, key in out.items() if "licen" not in name and f"{name} license" not in out}
    for terms, words in CC_TERMS.items():
        spaced = words.replace("sharealike", "share alike").replace("noncommercial", "non commercial").replace("noderivatives", "no derivatives")
        for version, port in CC_VERSIONS.items():
            v = version.replace(".", " ")
            for name in (f"cc {terms.lower().replace('-', ' ')}", f"creative commons {words}", f"creative commons {spaced}"):
                out |= {f"{name} {v}{tail}": f"CC-{terms}-{version}" for tail in ("", f" {port}", " license", f" {port} license")}
    return out


def joined(name: str) -> str:
    """A name as it stands once its own joints are closed."""
    for words, closed in WHOLE.items():
        name = name.replace(words, closed)
    return name


def _gnu():
    """Family, its terms and, for each version, the licence and the version as identifiers have it."""
    for family, (name, versions) in GNU.items():
        dotted = [v.replace(" ", ".") for v in versions]
        yield family, GNU_TERMS.format(name), [(v, d, f"{family}-{d if '.' in d else d + '.0'}") for v, d in zip(versions, dotted, strict=True)]


def sentences() -> dict[str, str]:
    """Normalised sentence of a licence text to identifier."""
    out = {text: key for key, texts in TEXTS.items() for text in texts}
    out |= {f"{text} {TEXTS['GPL:implied'][0]}": "GPL:useful" for text in TEXTS["GPL:useful"]}
    for family, terms, versions in _gnu():
        starts = [terms, *(f"{free} {terms}" for free in TEXTS["GPL:free"])]
        out |= dict.fromkeys(starts, f"{family}:terms")
        for v, dotted, key in versions:
            tails = [tail.format(v) for tail in GNU_VERSIONS]
            out |= dict.fromkeys(tails, f"GNU:version-{dotted}")
            out |= {f"{start} {tail}": f"{key}:terms" for start in starts for tail in tails}
    return out


def rules() -> list[tuple[str, list[str]]]:
    """Rules in order of precedence."""
    out, rest = list(RULES), ["GPL:useful", "GPL:implied", "GPL:details", "GPL:received"]
    afters = [rest, [rest[0], *rest[2:]], rest[:2], rest[:1], []]
    for family, _, versions in _gnu():
        for _, dotted, key in versions:
            grants = ([f"{key}:terms"], [f"{family}:terms", f"GNU:version-{dotted}"])
            out += [(key, [*before, *grant, *after]) for grant in grants for before in (["GPL:free"], []) for after in afters]
        out += [(family, ["GPL:free", f"{family}:terms"]), (family, [f"{family}:terms"])]
    return out + [(key, [key]) for key in dict.fromkeys(names().values())] + LAST
