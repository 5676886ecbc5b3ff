"""Known licences by the digest of their canonical text.

A text is brought to a canonical form that ignores what licences vary in (case, copyright lines,
punctuation, white space, spellings), and its SHA-256 is looked up among the digests of known texts.
All of it is done with SQL functions.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, written

#: Known digests that are broadcast; beyond this they are joined by shuffle.
FEW_LICENSES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only says who holds the copyright; in multi-line mode, where $ ends a line.
COPYRIGHT = r"^[^a-z0-9\n]*(?:copyright *(?:\(c\)|©|[0-9]|<|\[|\{)|\(c\) *[0-9]|© *[0-9]|all rights reserved)[^\n]*$"
#: What is no letter or digit, among ASCII and common typography.
PUNCTUATION = r"[\x00-/:-@\[-`{-\x7f‘’“”–—©®™…• ]+"
#: Spellings that count as one, applied in this order.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"),
    ("catalogue", "catalog"), ("copyright owner", "copyright holder"), ("customis", "customiz"), ("favour", "favor"),
    ("honour", "honor"), ("https", "http"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("maximis", "maximiz"), ("non commercial", "noncommercial"), ("organis", "organiz"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("recognis", "recogniz"), ("sub license", "sublicense"),
    ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
)

PERMISSIVE_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD_3 = BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + PERMISSIVE_END
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + PERMISSIVE_END
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

#: Names that one-line notices use, by SPDX identifier.
NAMES = {
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
    "EPL-1.0": ("the Eclipse Public License 1.0", "the Eclipse Public License, Version 1.0", "the Eclipse Public License v1.0"),
    "EPL-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0", "the Eclipse Public License v2.0"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPL-2.0"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPL-3.0"),
    "ISC": ("the ISC License",),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPL-3.0"),
    "MIT": ("the MIT License",),
    "MPL-1.1": ("the Mozilla Public License 1.1", "the Mozilla Public License, Version 1.1"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0"),
    "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",),
}
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC = {f"CC-{x}-{v}": (f"CC {x} {v}", f"CC-{x}-{v}", *(f"{a} Creative Commons {name} {v} {where} License" for a in ("a", "the"))) for x, name in CC_PARTS.items() for v, where in (("3.0", "Unported"), ("4.0", "International"))}
ONE_LINE = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")
#: Identifiers whose SPDX tag is known; texts of one family have the identifier without only or or-later.
TAGS = (*NAMES, *CC, *(f"{x}-or-later" for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")), "0BSD")
GNU = "This {thing} is free software{stop} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.\n\nThis {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\nYou should have received a copy of the {name} along with this {thing}{end}"
SEE, WRITE = ". If not, see <https://www.gnu.org/licenses/>.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
#: Notices that stand at the head of a file.
NOTICES = (
    *((f"{i}-{v if '.' in v else v + '.0'}-or-later", GNU.format(thing=thing, stop=stop, name=f"GNU {kind}General Public License", v=v, end=end))
      for i, kind, v in (("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))
      for thing in ("program", "library") for stop in ";:" for end in (SEE, WRITE)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
)
END = "END OF TERMS AND CONDITIONS"


def published() -> list[tuple[str, str]]:
    """The texts in license_texts, named by identifier; also without what follows the end of their terms."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if END in text:
            terms = text[: text.index(END)]
            out += [(path.stem, terms + END), (path.stem, terms)]
    return out


#: Published licence texts and notices. More are given by the caller.
KNOWN = (
    ("0BSD", ZERO_BSD), ("0BSD", "Zero-Clause BSD\n\n" + ZERO_BSD),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "Released under the Apache License."),
    ("BSD-2-Clause", BSD_2 + BSD_END), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD_3 + BSD_END), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Released under the BSD License."),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "Released under the MIT License."),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB),
    *published(), *NOTICES, *((i, f"SPDX-License-Identifier: {i}") for i in TAGS),
    *((i, line.format(name)) for i, names in (NAMES | CC).items() for name in names for line in ONE_LINE),
)


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as single spaces, one spelling; null is the empty text."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, "(?md)" + COPYRIGHT, "")
    t = F.trim(F.regexp_replace(t, PUNCTUATION, " "))
    for one, other in EQUIVALENT:
        t = F.replace(t, F.lit(one), F.lit(other))
    return t


def known_licenses(spark: SparkSession) -> DataFrame:
    """KNOWN as a table that lies in the plan, so that no Python runs for it on the executors."""
    ids, texts = zip(*KNOWN, strict=True)
    return spark.createDataFrame(pa.table({"license_id": list(ids), "license_text": list(texts)}))


def licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical_chars, digest, license_id) of each row of docs; license_id is null for a text that is no known licence.

    known: license_id and license_text. Texts that are empty in canonical form match nothing; of several
    ids with one canonical text the least is given. Null and empty texts, and those of copyright lines
    alone, have the empty canonical form. Repeated rows match alike; other columns of docs play no part.
    """
    form = canonical(F.col("license_text"))
    digests = known.where(form != "").groupBy(F.sha2(form, 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    forms = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("__form"))
    looked_up = forms.select(id_col, F.length("__form").cast("long").alias("canonical_chars"), F.sha2("__form", 256).alias("digest"))
    if known.count() <= FEW_LICENSES:
        return looked_up.join(F.broadcast(digests), "digest", "left").select(id_col, "canonical_chars", "digest", "license_id")
    return join_skewed(written(looked_up, "license-digests"), digests, "digest").select(id_col, "canonical_chars", "digest", "license_id")


def oracle() -> str:
    """licenses() of documents and KNOWN in SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        t = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
        t = f"regexp_replace({t}, {quoted('(?m)' + COPYRIGHT)}, '', 'g')"
        t = f"trim(regexp_replace({t}, {quoted(PUNCTUATION)}, ' ', 'g'), ' ')"
        for one, other in EQUIVALENT:
            t = f"replace({t}, '{one}', '{other}')"
        return t

    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return f"""
WITH known(license_id, license_text) AS (VALUES {rows}),
forms AS (SELECT license_id, {form("license_text")} AS form FROM known),
digests AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM forms WHERE form <> '' GROUP BY 1),
looked_up AS (SELECT doc_id, {form("text")} AS form FROM documents)
SELECT doc_id, length(form)::BIGINT AS canonical_chars, sha256(form) AS digest, license_id
FROM (SELECT doc_id, form, sha256(form) AS digest FROM looked_up) AS l LEFT JOIN digests USING (digest)
"""
