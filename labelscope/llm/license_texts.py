"""Templates of licence texts and notices, in public wording.

``[words]`` may be left out and ``{low,high}`` stands for so many words of any kind; all other
wording is mandatory. Letter case, punctuation and line breaks do not count.
"""

from __future__ import annotations

#: Notices that name a licence, by label.
NOTICES = {
    "apache-2.0": "licensed under the apache license [version] 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under [a] [the] [creative commons] cc by [license] [version] 4 0",
    "cc-by-nc-4.0": "licensed under [a] [the] [creative commons] cc by nc [license] [version] 4 0",
    "cc-by-sa-4.0": "licensed under [a] [the] creative commons attribution sharealike 4 0 international [public] [license]",
    "cc0-1.0": "to the extent possible under law {1,12} has waived all copyright and related or neighboring rights to",
    "copyright-notice": "copyright {1,8} all rights reserved",
    "gpl-3.0": "licensed under the [terms of the] [gnu] general public license [as published by the free software foundation] [either] [version] 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this {1,6} and associated documentation",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at]",
}

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {2,12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {2,14}
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: [1] Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. [2] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. [You should have received a copy of the GNU {name} along
with this program; if not, see] [http] [https] [www gnu org licenses]"""

#: Whole licence texts, and the standard notices that licences prescribe, by label.
TEXTS = {
    "0bsd-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "agpl-3.0-text": _GNU.replace("{name}", "Affero General Public License").replace("{version}", "3"),
    "apache-2.0-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at [http] [https] www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "bsd-2-clause-text": f"{_BSD} {_DISCLAIMER}",
    "bsd-3-clause-text": f"""{_BSD} [3] Neither the name of {{1,14}} nor the names of [its] [other] [the] contributors may be used to endorse or
promote products derived from this software without specific prior written permission. {_DISCLAIMER}""",
    "gpl-2.0-text": _GNU.replace("{name}", "General Public License").replace("{version}", "2"),
    "gpl-3.0-text": _GNU.replace("{name}", "General Public License").replace("{version}", "3"),
    "isc-text": """Permission to use, copy, modify, and [/or] distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND {1,6} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL {1,6} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-3.0-text": _GNU.replace("{name}", "Lesser General Public License").replace("{version}", "3"),
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [(including the
next paragraph)] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {1,10} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [1] The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. [2] Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. [3] This notice may not be removed or altered
from any source distribution.""",
}

TEMPLATES = NOTICES | TEXTS
