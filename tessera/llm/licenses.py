"""Licence scan by canonical digests.

Texts are normalised (case, punctuation, copyright lines, equivalent spellings)
and digested; entire texts, and single lines for short notices, are found by a
hash join with the digests of known licences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import LOWER, map_text
from .storage import written

#: Rows up to which the licence table is broadcast.
BROADCAST_ROWS = 100_000

#: Spellings that count as equal, as in the public licence matching guidelines.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial", "v2": "version 2", "v3": "version 3",
}

#: Entire licences, by their SPDX ids.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
}

LICENSES["BSD-3-Clause"] = LICENSES["BSD-2-Clause"].replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)

#: Titles that stand above these licences.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Fixed values: (digest, canonical length) of long licences, as Debian has their texts: with and
#: without title, with and without what follows the terms, with http and https.
LONG_TEXTS = {
    "Apache-2.0": (
        ("045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847", 9821),
        ("108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87", 8805),
        ("2136ccf013476faf84009ad5c667369e6718de5a3d755f97ad14c74f000e9f6f", 8736),
        ("46262ed7a2a06fdac885b37f111be9b18bbde572ab1edbd2f416d673551ab967", 8806),
        ("62c23944e22c7e1579b00eab372c8062d04f03e360aaab08b4030b71d5eac153", 9823),
        ("6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166", 8777),
        ("b0a60aaffc83b2bdcebe90ae6d33365e374a9bf69e8c2e80c0e8c51256d4fc93", 9753),
        ("b3b9336d65edf5556d0a2b4e3ad60eb60e7ee0e240d342b7ce6dece24ebd4678", 9752),
        ("cde7bc24bdbd45dc163ffe3310ac18828bc61ca29d7022e5423fc27c782c807a", 8778),
        ("f7f06cb4224881ac9986dc0a56633e3467a943381de5ff100c8c78ea89cc746f", 8708),
    ),
    "GPL-2.0": (
        ("1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca", 14484),
        ("331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6", 17118),
        ("3d6c536f38203f43d4f882a96f62d08ef68247a99702d48f1c232a3250b408c1", 14437),
        ("6a4c1793053c857132d6ee663db7a0978f0e41de21b44c2dc6020c39d6c38bbb", 14409),
        ("c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88", 14456),
        ("e96e14de9c3b9dd8fb9b9c693f78237578ae05d8105b2ec72bbc79daaac48990", 17071),
    ),
    "GPL-3.0": (
        ("04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3", 33356),
        ("092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", 30940),
        ("4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19", 30918),
        ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", 33409),
        ("ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", 30968),
        ("c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64", 33359),
        ("ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2", 30890),
        ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406),
    ),
    "LGPL-2.1": (
        ("127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd", 23277),
        ("48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", 23365),
        ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
        ("98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4", 23305),
        ("bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", 23337),
        ("e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f", 25157),
    ),
    "LGPL-3.0": (
        ("13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7", 7047),
        ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ),
    "MPL-2.0": (
        ("3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7", 14272),
        ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", 14271),
        ("c7625b8590f2bd72af25ea48c9d735f0b781eb75cc74e8419c28c89cb57a87fb", 14237),
        ("e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2", 14236),
    ),
    "CC0-1.0": (
        ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
        ("e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6", 6646),
    ),
}

#: One-line notices, by the SPDX ids they name.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
}

#: ASCII letters and digits and the bytes of other characters stay; the rest parts words.
TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)
#: Quotes, dashes, section marks and no-break spaces outside ASCII.
OTHER_MARKS = re.compile("|".join(re.escape(chr(c)) for c in (0xA0, 0xA7, 0xAB, 0xB7, 0xBB, *range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2022, 0x2026, 0x2039, 0x203A, 0x3000)).encode())
#: A line that begins so names an owner; a wrapped line of a licence may begin with "copyright notice".
COPYRIGHT_LINE = re.compile(rb"[\s#*/;.-]*(?:copyright\b(?!\s+(?:notices?|licen[cs]es?|holders?|owners?|laws?|and|or|interests?|permissions?|statements?|treaty|is|in|to|on|as|for|the|this|that|may|shall|control)\b)|\(c\)|\xc2\xa9|all rights reserved)", re.I)
_equivalent = {a.encode(): b.encode() for a, b in EQUIVALENT.items()}


def canonical(text: bytes | None) -> bytes:
    """Lower-case words joined by one space, without copyright lines."""
    if not text:
        return b""
    lower = text.lower()
    if b"copyright" in lower or b"(c)" in lower or b"\xc2\xa9" in text or b"all rights" in lower:
        text = b"\n".join(x for x in text.split(b"\n") if not COPYRIGHT_LINE.match(x))
    if not text.isascii():
        text = OTHER_MARKS.sub(b" ", text)
    return b" ".join(_equivalent.get(w, w) for w in text.translate(TO_WORDS).split())


def digest(text: bytes | None) -> str | None:
    words = canonical(text)
    return hashlib.sha256(words).hexdigest() if words else None


def forms(license_id: str) -> list[str]:
    """An entire licence without and with its titles, with and without numbers or
    other marks of its list, and in two common wordings."""
    text = LICENSES[license_id]
    bodies = {text, re.sub(r"(?m)^\d\. ", "", text)}
    bodies |= {b.replace("modify, and/or distribute", "modify, and distribute") for b in bodies}
    bodies |= {b.replace("SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT OWNER OR") for b in bodies}
    return sorted({f"{title}\n\n{b}" for b in bodies for title in ("", *TITLES.get(license_id, ()))})


def known_licenses() -> list[tuple[str, str, str, int]]:
    """(digest, licence, kind, canonical length) of the built-in table."""
    rows = [(i, "text", t) for i in LICENSES for t in forms(i)] + [(i, "notice", t) for i, ts in NOTICES.items() for t in ts]
    short = [(digest(t.encode()), i, kind, len(canonical(t.encode()))) for i, kind, t in rows]
    return short + [(d, i, "text", size) for i, ds in LONG_TEXTS.items() for d, size in ds]


def license_table(spark: SparkSession, known: Iterable[tuple[str, str, str, int]] | None = None) -> DataFrame:
    return spark.createDataFrame(list(known_licenses() if known is None else known), "digest string, license string, kind string, size int")


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_sha256 (of the canonical text, null if
    it has no words), license (smallest id whose whole text it is, or null) and
    notices (sorted ids that single lines name).

    Every text and line is normalised whole; lines whose canonical length is no
    known notice's cannot match and are not digested. Null and empty texts match
    nothing. Repeated rows and null ids keep their rows. An empty table of licences
    finds nothing. Texts aren't shuffled; the licences are broadcast up to
    BROADCAST_ROWS.
    """
    table = licenses if licenses is not None else license_table(docs.sparkSession)
    sizes = frozenset(r.size for r in table.where(F.col("kind") == "notice").select("size").distinct().limit(100_001).toLocalIterator())
    everything = len(sizes) > 100_000

    def make():
        def each(texts):
            whole, lines = [], []
            for t in texts:
                whole.append(digest(t))
                found = set()
                for line in t.split(b"\n") if t else ():
                    words = canonical(line)
                    if words and (everything or len(words) in sizes):
                        found.add(hashlib.sha256(words).hexdigest())
                lines.append(sorted(found))
            return [pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.string()))]

        return each

    scanned = map_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, [("text_sha256", T.StringType()), ("line_digests", T.ArrayType(T.StringType()))], "text", ["doc_id"])
    scanned = written(scanned)
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = lambda kind: (lambda d: F.broadcast(d) if small else d)(table.where(F.col("kind") == kind).groupBy("digest").agg(F.min("license").alias("license")))
    texts = held("text").select(F.col("digest").alias("text_sha256"), "license")
    # Lists of digests, not documents, are joined with the notices; documents without
    # any, nearly all, stay out of it.
    named = scanned.where(F.size("line_digests") > 0)
    lists = named.select("line_digests").distinct()
    notices = written(
        lists.select("line_digests", F.explode("line_digests").alias("digest")).join(held("notice"), "digest")
        .groupBy("line_digests").agg(F.sort_array(F.collect_set("license")).alias("notices"))
    )
    few = notices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    none = F.array().cast("array<string>")
    found = named.join(F.broadcast(notices) if few else notices, "line_digests", "left").select("doc_id", "text_sha256", F.coalesce("notices", none).alias("notices"))
    rest = scanned.where(F.size("line_digests") == 0).select("doc_id", "text_sha256", none.alias("notices"))
    out = found.unionByName(rest).join(texts, "text_sha256", "left")
    return out.select("doc_id", "text_sha256", "license", "notices")
