"""Licence scan by canonical digests: normalise a whole text, hash it, and join it to digests of known licences.

The canonical form lower-cases A-Z, drops copyright lines (a line that begins with "copyright" or its sign and then has
a sign, a year or a placeholder for one, or with the sign and then up to three words, so that wrapped sentences which happen to begin with that word stay), keeps runs
of letters, marks and digits separated by one space, and joins equivalent spellings. Two texts that differ only in those ways, as in
line width, quotation marks or dashes, have one digest. Known are the texts in `KNOWN` and the digests in
`KNOWN_DIGESTS`; both are parameters.

Rows: a null text is an empty text; an empty canonical form matches nothing. Repeated rows and ids are scanned each on
its own. The digest table is bounded by the list of known licences, which is checked before it is broadcast. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More known licences than this are joined by a shuffle.
MOST_BROADCAST = 10_000

#: Equivalent spellings, each second one is written as the first.
SPELLINGS = [
    ("license", "licence"), ("organization", "organisation"), ("acknowledgment", "acknowledgement"), ("merchantable", "merchantible"),
    ("noninfringement", "non infringement"), ("sublicense", "sub license"), ("whilst", "while"), ("copyright holder", "copyright owner"),
]

#: Texts of short public licences.
KNOWN = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License

Copyright (C) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

Copyright (C) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """BSD 3-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Licence line: MIT": "Licensed under the MIT License.",
    "Licence line: Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Licence line: CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Licence line: GPL-3.0": "Licensed under the GNU General Public License, version 3.",
}

#: Canonical digests of the longer public licences, from their published texts.
KNOWN_DIGESTS = {
    "Apache-2.0": "1b07a19b08098405fea05bd6dac32a536fdf9ecd3564fc1cc6d5bd2d9d0a4513",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "77a17c8586ad4a15f4c4a26f2d3ce87ea2e9ddfba1f8d2b714dd33eb7a1f65f6",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "Artistic-1.0": "50cd294a1f03da474a09c58d35e8078f45a5f25fe34ce03806cf2d892e193184",
    "GFDL-1.2": "9edfb600de196611e79d8eea197379d8a8b3d2ba7b6187387d6b094f3018be5c",
    "GFDL-1.3": "16f91013b1e2daad33fe7a48a544040827e07d2ea3263dd69a990cc9c495a948",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_YEAR = r"[\[<{]?(?:(?:19|20)[0-9][0-9]|year|yyyy)"
#: Lines of lower-cased text that name a holder or say "all rights reserved" only.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;>-]*(?:copyright[ \t]*(?:\(c\)|\x{a9}|" + _YEAR + r")[^\n]*|(?:\(c\)|\x{a9})[ \t]*(?:copyright|" + _YEAR + r")[^\n]*|(?:\(c\)|\x{a9})(?:[ \t]+[^ \t\n]+){1,3}[ \t]*|all rights reserved[. \t\r]*)$"


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " "))
    for one, other in SPELLINGS:
        t = F.replace(t, F.lit(other), F.lit(one))
    return t


def known_digests(spark, known: dict[str, str] = KNOWN, digests: dict[str, str] = KNOWN_DIGESTS) -> DataFrame:
    rows = spark.createDataFrame([(k, v) for k, v in known.items()], "license string, license_text string")
    found = rows.select(F.sha2(canonical(F.col("license_text")), 256).alias("canonical_sha256"), "license")
    found = found.unionByName(spark.createDataFrame([(v, k) for k, v in digests.items()], found.schema))
    return found.groupBy("canonical_sha256").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: dict[str, str] = KNOWN, known_sha256: dict[str, str] = KNOWN_DIGESTS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, canonical_sha256, license (null where the whole text is no known licence)."""
    d = docs.select("doc_id", canonical(F.col("text")).alias("form")).select("doc_id", F.sha2("form", 256).alias("canonical_sha256"))
    digests = known_digests(docs.sparkSession, known, known_sha256)
    empty = F.sha2(F.lit(""), 256)
    digests = digests.where(F.col("canonical_sha256") != empty)
    return d.join(F.broadcast(digests) if len(known) + len(known_sha256) <= MOST_BROADCAST else digests, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")
