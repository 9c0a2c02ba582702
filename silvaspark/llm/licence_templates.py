"""Licence notices in their families (GNU, Creative Commons, BSD) and whole licence texts, by SPDX identifier."""

from __future__ import annotations

from functools import cache
from pathlib import Path

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_SOURCE_BINARY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NEITHER = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by the organization."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_GNU = [
    ("GPL-1.0", "program", "General Public License", "1"), ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.0", "library", "Library General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"),
]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_PORTS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}


def families() -> list[tuple[str, str]]:
    """Notices of every member of a family, so that none is taken for its sibling."""
    out = []
    for spdx, what, title, v in _GNU:
        for name, which in ((f"{spdx}-or-later", f"either version {v} of the License, or (at your option) any later version"), (spdx, f"version {v} of the License")):
            out.append((name, f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as
                published by the Free Software Foundation; {which}. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY
                WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details."""))
        out.append((spdx, f"Licensed under the GNU {title}, version {v}."))
        out += [(f"{spdx}-or-later", f"Licensed under the GNU {title}, version {v}{late}.") for late in (" or later", " or any later version", ", or (at your option) any later version")]
    for code, title in _CC.items():
        for v, port in _PORTS.items():
            spdx, full = f"CC-{code}-{v}", title if v == "4.0" else title.replace("NoDerivatives", "NoDerivs")
            out.append((spdx, f"Licensed under CC {code} {v}."))
            for article in ("a", "the"):
                notice = f"licensed under {article} Creative Commons {full} {v} {port} License."
                out.append((spdx, notice))
                out.append((spdx, f"""This work is {notice} To view a copy of this license, visit http://creativecommons.org/licenses/{code.lower()}/{v}/ or send a
                    letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""))
    out += [
        ("BSD-2-Clause", f"{_SOURCE_BINARY} {_DISCLAIMER}"),
        ("BSD-3-Clause", f"{_SOURCE_BINARY} 3. {_NEITHER}"),
        ("BSD-3-Clause", f"{_SOURCE_BINARY} 3. {_NEITHER} {_DISCLAIMER}"),
        ("BSD-4-Clause", f"{_SOURCE_BINARY} {_ADVERTISING} 4. {_NEITHER}"),
        ("BSD-4-Clause", f"{_SOURCE_BINARY} {_ADVERTISING} 4. {_NEITHER} {_DISCLAIMER}"),
        ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"),
        ("0BSD", f"{_ISC}. {_ISC_DISCLAIMER}"),
    ]
    return out


@cache
def texts() -> list[tuple[str, str]]:
    """Whole licence texts, with and without what follows the end of their terms."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text("utf-8")
        out.append((path.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out.append((path.stem, terms))
    return out
