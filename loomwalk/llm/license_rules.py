"""Known licence sentences and ordered licence rules: constants of fixed size."""

#: (identifier, sentence).  Compared after normalisation, so case, punctuation and spacing do not matter.
SENTENCES: list[tuple[str, str]] = [
    ("MITref", "Released under the MIT License"),
    ("MITref", "Licensed under the MIT License"),
    ("MITref", "This project is licensed under the MIT License"),
    ("MITref", "This software is released under the MIT License"),
    ("MITgrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MITcond", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MITasis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("MITliable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("ISCasis", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("ISCliable", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("ISCgrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ApacheRef", "Licensed under the Apache License, Version 2.0"),
    ("ApacheRef", "This project is licensed under the Apache License, Version 2.0"),
    ("ApacheHead", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("ApacheUse", "you may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("GPL3ref", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL3ref", "Licensed under the GNU General Public License, version 3"),
    ("GPL2ref", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL2ref", "Licensed under the GNU General Public License, version 2"),
    ("LGPL3ref", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL3ref", "Licensed under the GNU Affero General Public License, version 3"),
    ("GPLfree3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPLfree2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPLnowar", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GPLsee", "See the GNU General Public License for more details"),
    ("GPLcopy", "You should have received a copy of the GNU General Public License along with this program"),
    ("LGPLfree3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPLfree21", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPLnowar", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("LGPLsee", "See the GNU Lesser General Public License for more details"),
    ("LGPLcopy", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("AGPLfree3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPLsee", "See the GNU Affero General Public License for more details"),
    ("AGPLcopy", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZlibLiable", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("EPLref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPLref", "Licensed under the Eclipse Public License 2.0"),
    ("BSDgrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDsource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDbinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDendorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDasis", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("BSDliable", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES"),
    ("BSDref", "Licensed under the BSD License"),
    ("BSD3ref", "Licensed under the BSD 3-Clause License"),
    ("BSD2ref", "Licensed under the BSD 2-Clause License"),
    ("MPLref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPLcopy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPLref", "Licensed under the Mozilla Public License 2.0"),
    ("CCBYNCref", "Licensed under CC BY-NC 4.0"),
    ("CCBYNCSAref", "Licensed under CC BY-NC-SA 4.0"),
    ("CCBYNDref", "Licensed under CC BY-ND 4.0"),
    ("CCBYSAref", "Licensed under CC BY-SA 4.0"),
    ("CCBYref", "Licensed under CC BY 4.0"),
    ("CC0ref", "Licensed under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("PublicDomain", "This work is released into the public domain"),
    ("BoostRef", "Distributed under the Boost Software License, Version 1.0"),
    ("AllRights", "All rights reserved"),
]

#: (licence, pattern over identifiers; "?" after one: it may be missing, "A|B": either).  Tried in order; what a rule matches is consumed before the next one.
RULES: list[tuple[str, str]] = [
    ("MIT", "MITgrant MITcond MITasis? MITliable?"),
    ("ISC", "ISCgrant ISCasis? ISCliable?"),
    ("BSD-3-Clause", "BSDgrant BSDsource BSDbinary BSDendorse BSDasis? BSDliable?"),
    ("BSD-2-Clause", "BSDgrant BSDsource BSDbinary BSDasis? BSDliable?"),
    ("Apache-2.0", "ApacheHead ApacheUse ApacheCopy? ApacheAsIs? ApacheSee?"),
    ("GPL-3.0-or-later", "GPLfree3 GPLnowar? GPLsee? GPLcopy?"),
    ("GPL-2.0-or-later", "GPLfree2 GPLnowar? GPLsee? GPLcopy?"),
    ("LGPL-3.0-or-later", "LGPLfree3 LGPLnowar? LGPLsee? LGPLcopy?"),
    ("LGPL-2.1-or-later", "LGPLfree21 LGPLnowar? LGPLsee? LGPLcopy?"),
    ("AGPL-3.0-or-later", "AGPLfree3 GPLnowar? AGPLsee? AGPLcopy?"),
    ("Zlib", "ZlibAsIs? ZlibLiable? ZlibGrant"),
    ("EPL-2.0", "EPLref"),
    ("Apache-2.0", "ApacheRef"),
    ("MIT", "MITref"),
    ("GPL-3.0-only", "GPL3ref"),
    ("GPL-2.0-only", "GPL2ref"),
    ("LGPL-3.0-only", "LGPL3ref"),
    ("AGPL-3.0-only", "AGPL3ref"),
    ("BSD-3-Clause", "BSD3ref"),
    ("BSD-2-Clause", "BSD2ref"),
    ("BSD", "BSDref"),
    ("MPL-2.0", "MPLref MPLcopy?"),
    ("CC-BY-NC-SA-4.0", "CCBYNCSAref"),
    ("CC-BY-NC-4.0", "CCBYNCref"),
    ("CC-BY-ND-4.0", "CCBYNDref"),
    ("CC-BY-SA-4.0", "CCBYSAref"),
    ("CC-BY-4.0", "CCBYref"),
    ("CC0-1.0", "CC0ref"),
    ("BSL-1.0", "BoostRef"),
    ("Unlicense", "(Unlicense|PublicDomain)"),
    ("All-Rights-Reserved", "AllRights"),
]

#: Every known sentence holds one of these, so a text without them has no known sentence.
_GAP = "[^a-z0-9]+(?:(?:rem|dnl)[^a-z0-9]+)?"
CUE = f"(?i)licen|permission|warrant|liable|mozilla|redistribut|copyright|rights{_GAP}reserved|public{_GAP}domain|free{_GAP}software"
#: Pieces end at white space after closing punctuation, or at a line end; a known sentence may fill several lines, see wrapped().
SPLIT = r"[.!?;:]+[\x20\x09-\x0D]+|[\x0A\x0D]+"
#: Where even a wrapped sentence ends: closing punctuation, or a line without letters and digits, such as a blank one in a comment.
STOP = r"[.!?;:]+[\x20\x09-\x0D]+|\n[^A-Za-z0-9\n]*(?=\n)"
#: Words that mark a line as a comment; other marks are no letters.
COMMENT = r"(?im)^[^a-z0-9\n]*(?:rem|dnl)(?=[^a-z0-9])"


#: A known sentence of so many words is found behind other words too, such as a title and a copyright line.
LONG = 8


def wrapped(pieces: list[str]) -> str:
    """Known pieces in a text of [a-z0-9 \\n|], "|" for a STOP: up to such an end or a line's, whatever line ends lie between.  Short ones begin where a line or
    sentence does, long ones with any word."""
    each = lambda some: "|".join(x.replace(" ", r"[ \n]") for x in sorted(some, key=len, reverse=True)) or "(?!)"
    long = [x for x in pieces if x.count(" ") >= LONG - 1]
    short = [x for x in pieces if x not in set(long)]
    return rf"(?:(?<![a-z0-9])(?:{each(long)})|(?<![^\n|])(?:{each(short)}))(?![^\n|])"


def normal(sentence: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def pattern(rule: str) -> str:
    """A rule as a regular expression over "<id><id>..."."""
    part = lambda x: "(" + "|".join(f"<{y}>" for y in x.rstrip("?").split("|")) + ")" + "?" * x.endswith("?")
    return "".join(map(part, rule.split(" ")))
