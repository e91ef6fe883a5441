"""License scans by canonical digest lookup.

A text is brought to canonical form: lower case, equivalent spellings unified,
copyright lines removed, punctuation and white space reduced. The SHA-256 of
the whole canonical text is joined with the digests of known license texts.
Lines that mention a license are looked up the same way, as whole texts of
their own, against known notices.

The known texts are a table given by the caller; it is broadcast only below
``BROADCAST_TEXTS`` rows of 32-byte digests and joined by shuffle above.

Defined results: a null text is empty and matches nothing; if several known
texts are equal in canonical form the smallest license id is reported;
repeated rows are looked up row by row; other columns are dropped, whatever
their names; long texts are digested whole; an empty list of known texts
matches nothing and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN

BROADCAST_TEXTS = 100_000
#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("https://", "http://"), ("&", " and "), ("favour", "favor"), ("organis", "organiz"), ("authoris", "authoriz"), ("merchantibility", "merchantability"))
#: Lines that state a copyright: the mark or word with a year (or its placeholder), the word with
#: the mark, or the sign. A sentence that merely begins with the word stays.
_MARK, _YEAR = r"(?:copyright|\(c\)|©)", r"[\[<{(]*(?:[0-9]{4}|yyyy|year)"
COPYRIGHT_LINE = rf"(?m)^[ \t#*/;-]*(?:{_MARK}[ \t]*(?:(?:{_MARK}|by)[ \t]*)*{_YEAR}[^\n]*|copyright[ \t]*(?:\(c\)|©)[^\n]*|©[^\n]*|all rights reserved[. \t]*)$"
#: What is no letter, mark or digit of any script: punctuation, symbols and white space.
OTHER = r"[^\p{L}\p{M}\p{N}]+"
#: Short notices and license texts under their public identifiers.
NOTICES = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _WARRANTY,
}


_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
TEXTS |= {
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
}


def known_texts() -> list[tuple[str, str]]:
    return sorted([(k, t) for k, t in TEXTS.items()] + [(k, t) for k, all_ in NOTICES.items() for t in all_])


def canonical(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``digest``, ``text_license``, ``notices`` (sorted ids).

    ``known``: columns license_id and text.
    """
    listed = known.dropna(subset=["license_id", "text"]).select(digest(F.col("text")).alias("d"), "license_id").groupBy("d").agg(F.min("license_id").alias("license"))
    listed = listed.where(F.col("d") != F.sha2(F.lit("").cast("binary"), 256))
    if listed.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        listed = F.broadcast(listed)
    rows = docs.select(F.monotonically_increasing_id().alias(f"{OWN}row"), F.col(id_col).alias(f"{OWN}id"), F.coalesce(F.col(text_col), F.lit("")).alias(f"{OWN}text"))
    lines = F.filter(F.split(f"{OWN}text", "\n"), lambda x: x.rlike("(?i)licen[cs]e"))
    units = rows.select(f"{OWN}row", f"{OWN}id", F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(F.col(f"{OWN}text")).alias("d"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("d")))).alias("units"))
    each = units.select(f"{OWN}row", f"{OWN}id", F.explode("units").alias("u")).select(f"{OWN}row", f"{OWN}id", "u.whole", "u.d").join(listed, "d", "left")
    out = each.where("whole or license is not null").groupBy(f"{OWN}row", f"{OWN}id").agg(F.max(F.when(F.col("whole"), F.col("d"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"), F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("notices"))
    return out.select(F.col(f"{OWN}id").alias(id_col), "digest", "text_license", "notices")
