"""Licenses known to ``licenses.query``: notices, standard headers and texts.

A template is (name, text, marks, unless). ``marks`` are phrases of the template that have to be among the shingles found,
where its other words are also those of another license; ``unless`` are phrases that show another license. Phrases are of
at most five words, as shingled. Full texts of the long licenses are in ``license_texts``."""

from __future__ import annotations

from pathlib import Path

Template = tuple[str, str, tuple[str, ...], tuple[str, ...]]

#: The lines of the first registered query, as they are in its SQL.
LINES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)

_WARRANTY_UPPER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_UPPER
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
    "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
    "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
    "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
    "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
    "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
    "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
    "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
    "in the form of machine-executable object code generated by a source language processor."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)

#: GNU licenses: name, words before "General Public License", version, title's date.
_GNU = (
    ("GPL-2.0", "GNU", "2", "June 1991"),
    ("GPL-3.0", "GNU", "3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero", "3", "19 November 2007"),
)


def _gnu() -> list[Template]:
    out: list[Template] = []
    for name, who, version, date in _GNU:
        low = f"{who} General Public License".lower()
        start = " ".join(low.split()[:3])  # with its leading "the", which other members of the family don't have
        full = f"the {start}"
        either = f"version {version}"
        out += [
            (name, f"it under the terms of the {who} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", (full, either), ()),
            (name, f"it under the terms of the {who} General Public License, version {version}, as published by the Free Software Foundation.", (full, either), ()),
            (name, f"it under the terms of the {who} General Public License as published by the Free Software Foundation; version {version} of the License.", (full, either), ()),
            (name, f"licensed under the {who} General Public License, version {version}", (full, either), ()),
            (name, f"licensed under the {who} General Public License v{version}", (full, f"v{version}"), ()),
            (name, f"under the terms of the {who} General Public License v{version}", (full, f"v{version}"), ()),
            (name, f"{who} GENERAL PUBLIC LICENSE Version {version}, {date}", (start, either), ()),
        ]
    return out


def _named() -> list[Template]:
    """One-line notices of licenses by name."""
    names = (
        ("MIT", "the MIT License"),
        ("Apache-2.0", "the Apache License 2.0"),
        ("Apache-2.0", "the Apache 2.0 License"),
        ("MPL-2.0", "the Mozilla Public License 2.0"),
        ("MPL-2.0", "the Mozilla Public License, version 2.0"),
        ("MPL-2.0", "the Mozilla Public License, v. 2.0"),
        ("BSD-2-Clause", "the BSD 2-Clause License"),
        ("BSD-3-Clause", "the BSD 3-Clause License"),
        ("ISC", "the ISC License"),
        ("Zlib", "the zlib License"),
        ("BSL-1.0", "the Boost Software License, Version 1.0"),
    )
    out: list[Template] = []
    for name, said in names:
        whole = [w.strip(".,") for w in said.lower().split()]
        marks = (" ".join(whole[:5]), " ".join(whole[-5:])) if any(c.isdigit() for c in said) else ()
        out += [(name, f"{verb} under {said}", marks, ()) for verb in ("licensed", "released", "distributed", "available")]
        out.append((name, f"under the terms of {said}", marks, ()))
    return out


def _commons() -> list[Template]:
    out: list[Template] = []
    for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        name, own = f"CC-{code}-4.0", f"{words.lower()} 4.0 international"
        out += [
            (name, f"licensed under a Creative Commons {words} 4.0 International License", (own,), ()),
            (name, f"licensed under the Creative Commons {words} 4.0 International License", (own,), ()),
            (name, f"Creative Commons {words} 4.0 International Public License", (own,), ()),
            (name, f"licensed under CC {code} 4.0", (), ()),
        ]
    return out


def _texts() -> list[Template]:
    unless = {"GPL-3.0": ("affero general public license version",)}
    folder = Path(__file__).parent / "license_texts"
    return [(f.stem, f.read_text("utf-8"), (), unless.get(f.stem, ())) for f in sorted(folder.glob("*.txt"))]


TEMPLATES: tuple[Template, ...] = (
    *((name, text, ("version 3",) if name == "GPL-3.0" else (), ()) for name, text in LINES),
    ("Apache-2.0", _APACHE, (), ()),
    ("MPL-2.0", _MPL, (), ()),
    ("MIT", _MIT, (), ()),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, (), ("neither the name of", "may not be used to")),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, ("to endorse or promote products",), ()),
    ("ISC", _ISC_HEAD + _ISC_KEPT + _ISC_TAIL, ("provided that the above copyright",), ()),
    ("0BSD", _ISC_HEAD + "." + _ISC_TAIL, (), ("provided that the above copyright",)),
    ("Zlib", _ZLIB, (), ()),
    ("BSL-1.0", _BOOST, (), ()),
    ("Unlicense", _UNLICENSE, (), ()),
    *_gnu(),
    *_named(),
    *_commons(),
    *_texts(),
)
