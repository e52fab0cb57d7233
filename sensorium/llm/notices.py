"""Licences told from whole licence texts, standard headers and SPDX lines.

A licence file is one bag of terms; of other files the runs of comment or plain lines that hold
a header word are, with their paragraphs, sentences and lines (``licences.pieces_of``). The nearest template by
TF-IDF cosine counts. Weights come from the templates alone, so a text's result does not depend on other texts.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

#: Whole licences are read from here, by name.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
GNU = {"GPL-2.0": ("GNU General Public License", "2", "June 1991"), "GPL-3.0": ("GNU General Public License", "3", "29 June 2007")}
GNU |= {"LGPL-3.0": ("GNU Lesser General Public License", "3", "29 June 2007"), "AGPL-3.0": ("GNU Affero General Public License", "3", "19 November 2007")}
GNU |= {"LGPL-2.1": ("GNU Lesser General Public License", "2.1", "February 1999"), "LGPL-2.0": ("GNU Library General Public License", "2", "June 1991")}
CC = {"CC-BY-4.0": ("Attribution", "BY"), "CC-BY-NC-4.0": ("Attribution-NonCommercial", "BY-NC"), "CC-BY-SA-4.0": ("Attribution-ShareAlike", "BY-SA")}
BSD_USE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
GOVERNED = ("Use of this source code is governed by a {0} license.", "Use of this source code is governed by a {0} license that can be found in the LICENSE file.", "Licensed under the {0} License.", "Released under the {0} License.", "{0} License", "The {0} License", "License: {0}")
#: Headers and titles, several a licence; whole licences that are short too.
HEADERS: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License 2.0", "Released under the Apache 2.0 license", "License: Apache 2.0",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        *[g.format("MIT") for g in GOVERNED], "MIT-style license",
    ],
    "BSD-2-Clause": [BSD_USE + BSD_END, *[g.format(n) for g in GOVERNED for n in ("BSD 2-Clause", "Simplified BSD")]],
    "BSD-3-Clause": [BSD_USE + BSD_NAMES + BSD_END, *[g.format(n) for g in GOVERNED for n in ("BSD 3-Clause", "New BSD", "BSD-style")]],
    "0BSD": [ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")],
    "ISC": [ISC, *[g.format("ISC") for g in GOVERNED]],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", "Licensed under the MPL 2.0 license"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal", "Licensed under CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication license"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense", "Released under the Unlicense"],
}
for _name, (_title, _version, _date) in GNU.items():
    HEADERS[_name] = [FREE.format(_title, _version) + " " + WARRANTY.format(_title), FREE.format(_title, _version), f"{_title} Version {_version}, {_date}", f"{_title} v{_name.rpartition('-')[2]}", f"Licensed under the {_title}, version {_version}", f"This program is free software; you can redistribute it and/or modify it under the terms of the {_title} version {_version} as published by the Free Software Foundation."]
for _name, (_title, _short) in CC.items():
    HEADERS[_name] = [f"Creative Commons {_title} 4.0 International Public License", f"This work is licensed under a Creative Commons {_title} 4.0 International License.", f"Licensed under CC {_short} 4.0", f"Licensed under the Creative Commons {_title} 4.0 license, https://creativecommons.org/licenses/{_short.lower()}/4.0/"]

WORD = re.compile(r"[a-z0-9]+")


def _bag(text: str) -> Counter:
    return Counter(WORD.findall(text))


class Notices:
    """Templates as weighed bags of terms, of length 1: ``vectors`` (licence, weights), and the terms' ``idf``."""

    def __init__(self) -> None:
        texts = [(name, h.lower()) for name, headers in HEADERS.items() for h in headers]
        for file in sorted(os.listdir(FOLDER)):
            with open(os.path.join(FOLDER, file), encoding="utf-8") as f:
                texts.append((file.removesuffix(".txt"), f.read().lower()))
        bags = [(name, _bag(t)) for name, t in texts]
        df = Counter(t for _, b in bags for t in b)
        self.rare = math.log(1.0 + len(bags)) + 1.0
        self.idf = {t: math.log((1.0 + len(bags)) / (1.0 + n)) + 1.0 for t, n in df.items()}
        self.vectors = []
        for name, b in bags:
            v = self._weigh(b)
            norm = math.sqrt(sum(w * w for w in v.values()))
            self.vectors.append((name, {t: w / norm for t, w in v.items()}))
        self.names = {n.lower(): n for n in {n for n, _ in bags}}

    def _weigh(self, bag: Counter) -> dict[str, float]:
        return {t: n * self.idf.get(t, self.rare) for t, n in bag.items()}
