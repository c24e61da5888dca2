"""Licence scan: whole texts are brought to a canonical form and joined to digests of known licences.

The canonical form has no case, punctuation, list markers or copyright lines, single blanks, one spelling of
words that licences spell in several ways, and one word for the owner where a licence lets it be filled in (as in
"neither the name of ... nor the names of its contributors"). All line ends count alike. Texts are equal in it
or not; nothing is searched within a text. All of it is DataFrame functions.

Known are short licences by their texts, each with and without its usual titles, and long ones by the digests of
their public texts (`digest_of` makes them); a table (license, text) can be given instead.

Defined cases: null and empty texts, and texts of copyright lines alone, have the digest of the empty
text, which no licence has. Equal known texts count as the first name. Repeated rows and null doc_ids are judged as others.
Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirespan.llm.line_dedup import ascii_lower

#: Line ends, to \\n.
ENDS = "\r\x85\u2028\u2029"
#: Lines that name an owner, after lower-casing: copyright with a sign, a year or a placeholder, and not where a sentence happens to wrap.
OWNER = r"(?m)^[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*(?:copyright[\x20\t]*(?:\(c\)|\x{A9}|[0-9]{4}|[:\[<{]|the\x20[a-z]+\x20(?:authors|project))|\x{A9}[\x20\t]*[0-9a-z<\[{]|\(c\)[\x20\t]*[0-9]{4}|all rights reserved)[^\n]*$"
#: List markers: at the start of a line, or after the end of a clause.
MARKER = r"(?m)(^[\x20\t*/#;-]*|[.:;,][\x20\n\t]+(?:and[\x20\n\t]+|or[\x20\n\t]+)?)\(?(?:[0-9]{1,2}|[a-h]|[ivx]{1,4})[.)](?:[\x20\n\t]+)"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{AB}\x{BB}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{FEFF}]+"
#: Where an owner is filled in, in the canonical words, and what stands there instead.
FILLED = [
    (r"neither the names? of .{1,160}? nor the names? of (?:its |their |any |other )?contributors", "neither the name of owner nor the names of contributors"),
    (r"software is provided by .{1,120}? as is", "software is provided by owner as is"),
    (r"in no event (?:shall|will) .{1,120}? be (?:held )?liable", "in no event shall owner be liable"),
]
# Spellings that count as equal, word by word.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_TAIL = _AS_IS + " AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MORE_INFO = " For more information, please refer to <https://unlicense.org>"
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. ' + _AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
# Public licence texts without owners, and the titles they usually have.
TEXTS = [
    ("MIT", _MIT, ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "Expat License", "License: MIT"]),
    ("MIT-0", _MIT.replace(" subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "").replace("to do so,", "to do so"), ["MIT No Attribution", "MIT-0"]),
    ("ISC", _ISC + _ISC_TAIL, ["ISC License", "The ISC License", "ISC", "ISC License (ISC)"]),
    ("ISC", _ISC.replace("and/or", "and") + _ISC_TAIL, ["ISC License", "The ISC License"]),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL, ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"]),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "FreeBSD License", "BSD License"]),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "BSD-3-Clause", "The BSD License"]),
    ("BSD-4-Clause", _BSD_HEAD + _ADVERT + _BSD_THIRD.replace("3. ", "4. ") + _BSD_TAIL, ["BSD 4-Clause License", "Original BSD License"]),
    ("Zlib", _ZLIB, ["zlib License", "The zlib License", "zlib/libpng license"]),
    ("Unlicense", _UNLICENSE, ["The Unlicense", "Unlicense"]), ("Unlicense", _UNLICENSE + _MORE_INFO, ["The Unlicense", "Unlicense"]), ("Unlicense", _UNLICENSE + " For more information, please refer to <http://unlicense.org/>", ["The Unlicense", "Unlicense"]),
    ("BSL-1.0", _BOOST, ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0", "Boost Software License - Version 1.0"]),
]
# SHA-256 of the canonical form of public texts too long to stand here, whole and without what follows their terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "49b31ecf4e5fa0aaa1f5b1e94d7f7500529753a0580761e02dfd9c2b57f250f2"),
    ("Apache-2.0", "af0aeb2bafaa5170910a9db5d36f960183dbbe885bac19f30b7278c8178ec93f"),
    ("Apache-2.0", "c442b80e55fc9a755e9329b4826cccafc6ef37fe5a016c96098903f340f751f8"),
    ("Artistic-1.0-Perl", "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49"),
    ("CC-BY-SA-4.0", "d82b8abc5ef1d979fc2e31a300799e7f1fd708ffc841b216af2cad46339a1119"),
    ("CC0-1.0", "cc4b964958f0bb3b9415dfa9bdd1858915cd93dfbf6db0f281ce3a801d8d9ab8"),
    ("GCC-exception-3.1", "5bb6ba6d6006fa3099b4b0425bcc083672b36be46c5477d70cb6da17d6ffd92f"),
    ("GFDL-1.2", "a6eb25f719416e91b29aac6c112c47193dd7e082827a118ac1ee2823598a36ea"),
    ("GFDL-1.3", "e2a78dc72d31f5db4b584ca44b94b5990e1e35db1f53b10374a8c9aa85116db2"),
    ("GPL-1.0", "8779beee967ecd6ba7edd9e3c1f997470b1a2e73d9a5873e9f077a85b1e41497"),
    ("GPL-1.0", "a7bce65e5dba16d91866e60621b8ba783a0a808bd63a601f8dc9eee8c8ae3441"),
    ("GPL-1.0", "fe80ccaae90d81557cc6613b788c47dd1819c7a5ae034f77e7d60bb6b879677e"),
    ("GPL-2.0", "000bf5c45aef36f5bcf6bb017a731b989d46099d8945f553cccea6968116e945"),
    ("GPL-2.0", "18f9c10729a50636e0bc5084465789ed5a3b2314f3185a9a29af50ef2445dc68"),
    ("GPL-2.0", "7314c07a2d29e5446bcf514fee47b5f438deff8b1eed122fa2ee257c02b47bb7"),
    ("GPL-2.0", "9bba28cac1f8a7f37ce08a09c785f13b16cd1c85187fb284f4fba32592e5e127"),
    ("GPL-2.0", "9c942f6942a3d44037aa20b92138b7de02aafd88adea708e7c93f34a145aeaa1"),
    ("GPL-2.0", "aaf810f79057b02996d56055b9283d413e337af7e865d34d78ee9bb718d44586"),
    ("GPL-3.0", "02f3958327ccc161cf1d0294ea7c618f5da6a4fb225fada20cf88cd4738945a2"),
    ("GPL-3.0", "0c2238fa376b1d1c0bdff9091986ccddffe2eb72fec7082d10c83ccd3cbce2dd"),
    ("GPL-3.0", "24ac0807cf5e6ed9b2d32c8a7e22620344f761ea9ead876c2d2c6c6b990f718c"),
    ("GPL-3.0", "a48baf436c3656655cbd1c0fad60d8bd8e4c67eb037131879addf398548b3eaf"),
    ("GPL-3.0", "bbbd2e70dbaac86c1e4111dd51e43e7a496d6ec5079eaf049ac589a959864657"),
    ("GPL-3.0", "eb6f9b8536e1d751d8735da9d78b6bcae9c66e966207e3aac6a5a33afa726469"),
    ("LGPL-2.0", "266ff884b67ad1a18c23de3fcd3a85031cd82a9e4b709657b913881289f7befb"),
    ("LGPL-2.0", "94fb8a7d05eacb1a531acd9296246548059a4db98644a8bd0b02cbab4ffec65d"),
    ("LGPL-2.0", "e5d84190aab6a9603e16f3d399fd871e7ca07400ebe661b8d9628887c400cab7"),
    ("LGPL-2.1", "42887ba7e7e08254b82cf601965ff62f63f07c7078322d138a27eedfdabbd359"),
    ("LGPL-2.1", "6d595fe6e15f49c076609b6f6edc3970f501fc3990bd70d30373b0a0c671097a"),
    ("LGPL-2.1", "ca3d7d43df0c144084b3bc4d30e7e6af5e29a3b2df6ddcfad02555a7a6135656"),
    ("LGPL-3.0", "8b382dd66ce8da3b3b61af92a44dcc9e4dc64c240fefd721ed7bc1022686dbc9"),
    ("MPL-1.1", "3a158b31bd94ed9d352111ba993587d28c9bf22d2ad69f6439e6d5d508212adb"),
    ("MPL-2.0", "ce52e246d32d02fa0c9a78fd78d5c2df280726e4c03ac31439229658e59e2332"),
    ("OFL-1.1", "76d19ea4d6b80955703b40c05618e902655c15de2ea6bb6e9aac8e56c7bcd2b2"),
    ("Unicode-3.0", "cddb8ec678a0dabd311c33ec87b12ad7b86bd9cd84c404094c8dad335eb81496"),
]
#: (license, text) of the short ones: plain, and below each title.
KNOWN = [(name, (f"{title}\n\n{text}" if title else text)) for name, text, titles in TEXTS for title in ("", *titles)]


def canonical(text: Column) -> Column:
    lines = F.translate(ascii_lower(F.coalesce(text, F.lit(""))), ENDS, "\n" * len(ENDS))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, OWNER, ""), MARKER, "$1"), GAP, " ")
    equal = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    made = F.concat_ws(" ", F.transform(words, lambda w: F.coalesce(F.element_at(equal, w), w)))
    for pattern, owner in FILLED:
        made = F.regexp_replace(made, pattern, owner)
    return made


def digest_of(text: Column) -> Column:
    """The digest of a text's canonical form, which names what licence it is."""
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """doc_id, digest (of the canonical text) and license (null where it is none that is known)."""
    spark = docs.sparkSession
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(known, "license string, text string")
    named = known.select("license", digest_of(F.col("text")).alias("digest")).where(canonical(F.col("text")) != "")
    if digests:
        named = named.unionByName(spark.createDataFrame(digests, "license string, digest string"))
    named = named.groupBy("digest").agg(F.min("license").alias("license"))
    return docs.select("doc_id", digest_of(F.col("text")).alias("digest")).join(named, "digest", "left").select("doc_id", "digest", "license")
