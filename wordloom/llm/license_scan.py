"""License scan: exact set-similarity join of word windows with license templates.

A text block is a window of 2n consecutive words at every n-th word, n the template's length in words,
so every stretch of n words lies whole in a block. A block matches when it contains at least
``threshold`` of the template's distinct words. The words of all templates are ordered by their
frequency over the whole corpus, rarest first, and both sides hold their distinct words in that order;
of a block only words of some template count, as no other can be in common. Filters, none of which
loses a match of a template of m words that needs k of them:

* length: a block with fewer than k such words, counted by their places before any set is made;
* prefix: the m - k + 1 rarest of the template and the b - k + 1 rarest of a block's b have none in common;
* position: while both orders are merged, with c words in common before place p of the template and q
  of the block, c + min(m - p, b - q) is the most that there can be; below k the merge ends.

What is merged to the end is verified on the whole sets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import by_text

# Phrases whose places count, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# One-line license notices in common use, by label.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("cc0", "this work is dedicated to the public domain under cc0"),
)
# The texts of licenses, and the notices that stand in files instead of a long license's text. Names of holders are left out.
BODIES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
    publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
    subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
    substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
    NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
    OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
    contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE
    IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
    CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
    above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
    WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
    arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
    applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
    product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
    misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
    or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
    means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
    software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
    successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
    under copyright law."""),
    ("apache-2", """you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
    License."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
    that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
    the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope
    that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
    the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
)
# Labels whose templates differ in so few words that one's notice matches the others'.
FAMILIES = (frozenset({"gpl-2", "gpl-3", "lgpl-3"}),)
THRESHOLD = 0.8

#: Bytes that aren't part of a word become spaces, A-Z become a-z; bytes of non-ASCII characters stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def as_templates(rows: Iterable[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """(label, text) with the text as its words; texts without words are left out."""
    found = ((label, b" ".join(words_of(text.encode())).decode()) for label, text in rows)
    return tuple(t for t in found if t[1])


#: Goes along with the task: at most MOST_TEMPLATES of them.
TEMPLATES = as_templates(NOTICES + BODIES)
MOST_TEMPLATES = 1000


def templates_of(table: DataFrame, label_col: str = "label", text_col: str = "text") -> tuple[tuple[str, str], ...]:
    """Templates from a table of whole license texts, for scan_licenses; ValueError for more than MOST_TEMPLATES. Null labels and texts are left out."""
    rows = table.select(label_col, text_col).where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} license templates")
    return as_templates(sorted(map(tuple, rows)))


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of a bounded vocabulary stands in all documents; sent to the driver."""

    def work(_, texts):
        n = Counter()
        for x in texts:
            n.update(filter(vocabulary.__contains__, words_of(x)))
        return n.items()

    rows = by_text(docs, None, text_col, work, "word binary, n long", binary=True)
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _common(x: list[int], y: list[int], p: int, q: int, need: int) -> int:
    """Number of common elements of two sorted lists, the first at places p and q; 0 as soon as fewer than need are left (position)."""
    c = 0
    while p < len(x) and q < len(y):
        if c + min(len(x) - p, len(y) - q) < need:
            return 0
        if x[p] == y[q]:
            c, p, q = c + 1, p + 1, q + 1
        elif x[p] < y[q]:
            p += 1
        else:
            q += 1
    return c if c >= need else 0


class Scanner:
    def __init__(self, counts: dict[bytes, int], templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD):
        self.threshold, self.phrases = threshold, [(p.encode().split(), label) for p, label in phrases]
        vocabulary = {w for _, t in templates for w in t.encode().split()}
        self.order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.templates: list[tuple[str, int, list[int], int]] = []
        #: By template length: the least number of words needed, and templates by the words of their prefix, with the place there.
        self.index: dict[int, tuple[int, dict[int, list[tuple[int, int]]]]] = {}
        for t, (label, text) in enumerate(templates):
            words = text.encode().split()
            ranks = sorted({self.order[w] for w in words})
            need = ceil(threshold * len(ranks) - 1e-9)
            self.templates.append((label, len(words), ranks, need))
            least, prefix = self.index.get(len(words), (need, {}))
            for p, r in enumerate(ranks[: len(ranks) - need + 1]):
                prefix.setdefault(r, []).append((t, p))
            self.index[len(words)] = min(least, need), prefix
        self.first = frozenset(p[0] for p, _ in self.phrases)
        self.seen: Counter = Counter()  # blocks, and what each filter has left of blocks with templates

    def base(self, words: list[bytes], have: set[bytes]) -> tuple[list[int], set[str]]:
        starts, labels = [], set()
        for phrase, label in self.phrases:
            if have.issuperset(phrase):
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        starts.append(at)
                        labels.add(label)
        return starts, labels

    def blocks(self, words: list[bytes], have: set[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, containment) of every block that matches, start and end in words."""
        present = {self.order[w] for w in have.intersection(self.order)}
        live = [(n, least, prefix, rare) for n, (least, prefix) in self.index.items() if (rare := present.intersection(prefix))]
        if not live:
            return []
        places = [k for k, w in enumerate(words) if w in self.order]
        ranks = [self.order[words[k]] for k in places]
        found = []
        for n, least, prefix, rare in live:  # only blocks that hold a word of some prefix
            for b in sorted({x for k, r in zip(places, ranks, strict=True) if r in rare for x in (k // n - 1, k // n) if x >= 0}):
                x, y = bisect_left(places, b * n), bisect_left(places, b * n + 2 * n)
                self.seen["blocks"] += 1
                if y - x < least:  # length
                    continue
                self.seen["length"] += 1
                own = sorted(set(ranks[x:y]))
                tried = set()
                for q, r in enumerate(own[: len(own) - least + 1]):
                    for t, p in prefix.get(r, ()):
                        _, _, template, need = self.templates[t]
                        if t in tried or q > len(own) - need:  # prefix
                            continue
                        tried.add(t)
                        self.seen["prefix"] += 1
                        if both := _common(template, own, p, q, need):
                            found.append((t, b * n, min(len(words), b * n + 2 * n), both / len(template)))
        return sorted(found)

    def named(self, blocks: list[tuple[int, int, int, float]], words: list[bytes]) -> set[str]:
        """Labels of all blocks, but for those that another of the family outdoes on the same words."""
        labels = {self.templates[t][0] for t, *_ in blocks}
        for family in FAMILIES:
            if len(labels & family) > 1:
                own = sorted((x for x in blocks if self.templates[x[0]][0] in family), key=lambda x: x[1])
                starts, reach = [a for _, a, _, _ in own], max(b - a for _, a, b, _ in own)
                labels -= family
                for x in own:
                    if (label := self.templates[x[0]][0]) not in labels:
                        near = own[bisect_left(starts, x[1] - reach) : bisect_left(starts, x[2])]
                        if not any(self._outdone(x, y, words) for y in near):
                            labels.add(label)
        return labels

    def _outdone(self, x: tuple[int, int, int, float], y: tuple[int, int, int, float], words: list[bytes]) -> bool:
        """Whether y has greater containment and all that x has in common with its template is y's too, where they overlap."""
        (t, a, b, c), (u, v, w, d) = x, y
        if c >= d or max(a, v) >= min(b, w):
            return False
        ranks = lambda a, b: {self.order.get(x) for x in words[a:b]}
        return ranks(a, b).intersection(self.templates[t][2]) <= ranks(max(a, v), min(b, w)).intersection(self.templates[u][2])


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<label:string,start:long,end:long,containment:double>>"
)


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES, phrases=PHRASES, threshold=THRESHOLD) -> DataFrame:
    """A row for each row of docs: counts and places of the phrases, labels, and all matching blocks.

    Every matching block is in blocks, and its label in labels, unless an overlapping block of its family
    (FAMILIES) has greater containment on the same words.

    score: 1 if a phrase stands in the text, else the best containment of a matching block, else 0.
    Two passes: corpus-wide counts of the templates' words (a bounded vocabulary), then the join.
    Null or empty text: no words, no labels, score 0. A null id stays null; repeated rows give
    repeated results; ties don't matter. Empty table: no rows. Other columns are ignored.
    """
    vocabulary = frozenset(w for _, t in templates for w in t.encode().split())
    scanner = Scanner(word_counts(docs, vocabulary, text_col), templates, phrases, threshold)

    def work(ids, texts):
        for i, data in zip(ids, texts, strict=True):
            words = words_of(data)
            have = set(words)
            starts, base = scanner.base(words, have)
            blocks = scanner.blocks(words, have)
            labels = base | scanner.named(blocks, words)
            yield (
                i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                1.0 if base else max((c for *_, c in blocks), default=0.0),
                [{"label": scanner.templates[t][0], "start": a, "end": b, "containment": c} for t, a, b, c in blocks],
            )

    return by_text(docs, id_col, text_col, work, SCHEMA, binary=True).withColumnRenamed("id", id_col)
