"""Licence notices and grants as licences state them, with a label per licence and version.

Paragraphs are one text each, without line ends and apostrophes, so that SQL can quote them.
"""

_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_DISCLAIMER = (
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,"
    " OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR"
    " PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"
)


def _gnu(name: str, version: str) -> str:
    return (
        f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by"
        f" the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


_GNU = (
    ("gpl-2.0", "General Public License", "2"),
    ("gpl-3.0", "General Public License", "3"),
    ("lgpl-2.0", "Library General Public License", "2"),
    ("lgpl-2.1", "Lesser General Public License", "2.1"),
    ("lgpl-3.0", "Lesser General Public License", "3"),
    ("agpl-3.0", "Affero General Public License", "3"),
)
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial",
    "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_CC_OLD = {k: v.replace("NoDerivatives", "NoDerivs") for k, v in _CC.items()}


def _creative_commons() -> list[tuple[str, str]]:
    found = [(f"cc-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items()]
    for version in ("2.0", "2.5"):
        found += [(f"cc-{k}-{version}", f"This work is licensed under a Creative Commons {v} {version} License.") for k, v in _CC_OLD.items()]
    return found + [
        (f"cc-{k}-3.0", f"This work is licensed under a Creative Commons {v} 3.0 Unported License.") for k, v in _CC_OLD.items()
    ]


NOTICES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "mit",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
        " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS"
        " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
        " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission.",
    ),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,"
        " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED." + _DISCLAIMER,
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS"
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
        " governing permissions and limitations under the License.",
    ),
    (
        "apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,"
        " non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly"
        " display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "mpl-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except"
        " in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    ),
    *((label, _gnu(name, version)) for label, name, version in _GNU),
    ("gpl", _WARRANTY + " See the GNU General Public License for more details."),
    (
        "gpl",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is"
        " available at https://www.eclipse.org/legal/epl-2.0",
    ),
    (
        "bsl-1.0",
        "Distributed under the Boost Software License, Version 1.0. See accompanying file or copy at http://www.boost.org/LICENSE_1_0.txt",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
        " redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you"
        " must not claim that you wrote the original software.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
        " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
        " non-commercial, and by any means.",
    ),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the"
        " CC0 1.0 Universal Public Domain Dedication.",
    ),
    *_creative_commons(),
)

# Words that must stand one after the other in a block, by label: what tells a licence from
# others of nearly the same words.
TELLING = {
    "0bsd": "hereby granted. THE SOFTWARE IS PROVIDED",
    **{label: f"GNU {name}" for label, name, _ in _GNU},
    **{f"cc-{k}-4.0": f"Commons {v} 4.0" for k, v in _CC.items()},
    **{f"cc-{k}-{version}": f"Commons {v} {version}" for version in ("2.0", "2.5", "3.0") for k, v in _CC_OLD.items()},
}
# The same for a second run of words.
VERSIONS = {label: f"version {version} of the License" for label, _, version in _GNU}
