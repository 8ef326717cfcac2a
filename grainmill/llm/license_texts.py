"""Well-known short licences, as published, and notices in the usual wordings. Digests of longer texts are in license_digests."""

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: licence identifier, text
KNOWN: list[tuple[str, str]] = [
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_WARRANTY}"),
    ("MIT-0", f"{_MIT_GRANT}.\n{_MIT_WARRANTY}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_TERMS}{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS}{_BSD_THIRD}{_BSD_WARRANTY}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: licence identifier, names that notices give it. Short names of the GPL family are not among them: "GPLv3" and "GPLv3+" have one canonical form.
NAMES: dict[str, tuple[str, ...]] = {
    "0BSD": ("0BSD License", "BSD Zero Clause License", "Zero-Clause BSD License"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0 License"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0", "Apache-2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"),
    "BUSL-1.1": ("Business Source License 1.1", "Business Source License, version 1.1"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, version 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v. 2.0"),
    "EUPL-1.2": ("European Union Public License 1.2", "EUPL 1.2", "EUPL v1.2"),
    "GFDL-1.3-only": ("GNU Free Documentation License, Version 1.3",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GPL-2.0 License"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GPL-3.0 License"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later"),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1 License"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0 License"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later",),
    "MIT": ("MIT License", "MIT"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, version 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0 License", "MPL 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL",),
    "Zlib": ("zlib License",),
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _words in _CC.items():
    for _version, _kind in (("4.0", "International"), ("3.0", "Unported")):
        _full = f"Creative Commons {_words} {_version}"
        NAMES[f"CC-{_code}-{_version}"] = (f"CC {_code} {_version}", f"CC-{_code}-{_version}", f"Creative Commons {_code} {_version}", _full, f"{_full} License", f"{_full} {_kind}", f"{_full} {_kind} License")
_VERBS = ("Licensed", "Released", "Distributed", "Available", "Published")
_THINGS = ("work", "project", "software", "program", "library", "code", "file", "document", "content", "text", "article", "page", "site", "package", "repository", "material", "dataset")
#: A notice is a start, a name and a tail.
STARTS = [f"{start}{the}" for start in ["License: ", *(f"{verb} under " for verb in _VERBS), *(f"This {thing} is {verb} under " for thing in _THINGS for verb in _VERBS)] for the in ("", "the ")]
TAILS = ["", " - see the LICENSE file for details", " - see the LICENSE.md file for details", ". See LICENSE for details", ". See the LICENSE file for details"]
SPDX = [(i, f"SPDX-License-Identifier: {i}") for i in NAMES] + [(i, f"SPDX-License-Identifier: {i.removesuffix('-only')}") for i in NAMES if i.endswith("-only")]
