"""License scans by sentence rules (operator 2).

A catalogue names the sentences of licence texts and notices; ``{}`` in one
stands for up to ``SLOT`` words, such as the name of a holder. A text is cut
into fragments at ends of sentences and lines, commas and parentheses; a
sentence may run over several fragments, so from each fragment on, the words of
the following ones are added up to the next end of a sentence, and each state
is looked up among the known sentences (lower-cased words without punctuation).
Where none begins with the fragment, it may begin within, at a word like
"licensed" that no negation precedes ("This file is *licensed under the MIT
License*"). A line with an SPDX identifier is a sentence that names its
licence itself. The identifiers in the order of the text are matched against
the rules, each an ordered sequence of identifiers: from left to right, the
longest rule that fits is taken. A rule breaks off where more than ``MAX_GAP``
unknown words stand between two of its sentences.

Defined results: null and empty texts match nothing. A sentence that belongs to
no rule at its place is reported as ``partial`` with the licences it may stem
from. Repeated sentences are repeated findings, repeated rows rows of their
own. Empty tables give an empty result; extra columns are ignored. Nothing is
shuffled: a text is scanned where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GAP = 40
#: So many words at most stand for "{}" in a sentence.
SLOT = 12

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-title": "The MIT License",
    "mit-title-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit0-title": "MIT No Attribution",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-work": "This work is licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-name-2": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty-2": "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-released": "Released under the BSD License.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-released": "Released under the Apache License, Version 2.0.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-write": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl2-write-2": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA.",
    "gpl-received-see": "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "gpl-received-see-2": "You should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl3-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "lgpl2-details": "See the GNU Library General Public License for more details.",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-domain": "This work is dedicated to the public domain under CC0 1.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "rights-reserved": "All rights reserved.",
}

_BSD_NAMES = [("BSD-2-Clause", [[]]), ("BSD-3-Clause", [["bsd-name"], ["bsd-name-2"]])]
_BSD_ENDS = [["bsd-warranty", "bsd-liability"], ["bsd-warranty-2", "bsd-liability"], ["bsd-warranty-2"]]

# Ordered rules, each with the SPDX name of its licence.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "as-is-software", "mit-liability"]),
    ("MIT", ["mit-title-2", "mit-grant", "mit-condition", "as-is-software", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is-software", "mit-liability"]),
    ("MIT-0", ["mit0-title", "mit0-grant", "as-is-software", "mit-liability"]),
    ("MIT-0", ["mit0-grant", "as-is-software", "mit-liability"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-work"]),
    ("MIT", ["mit-project"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"]),
    *[(name, ["bsd-grant", "bsd-source", "bsd-binary", *named, *end]) for name, names in _BSD_NAMES for named in names for end in _BSD_ENDS],
    ("BSD", ["bsd-released"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-released"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["gpl3-licensed"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("LGPL-3.0-only", ["lgpl-work"]),
    ("AGPL-3.0-only", ["agpl-work"]),
    ("MPL-2.0", ["mpl-terms", "mpl-copy"]),
    ("MPL-2.0", ["mpl-terms"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-domain"]),
    ("CC0-1.0", ["cc0-domain"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("LicenseRef-all-rights-reserved", ["rights-reserved"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details", "gpl2-write"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details", "gpl2-write-2"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details", "gpl-received-see"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details", "gpl-received-see-2"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details", "gpl2-write"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details", "gpl2-write-2"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details", "gpl-received-see"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details", "gpl-received-see-2"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-hope", "gpl-details", "gpl-received"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-hope", "gpl-details", "gpl2-write"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-hope", "gpl-details", "gpl2-write-2"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-hope", "gpl-details", "gpl-received-see"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-hope", "gpl-details", "gpl-received-see-2"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", ["gpl2-only-2"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl2-write"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl2-write-2"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received-see-2"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-2.0-or-later", ["lgpl2-later", "lgpl-hope", "lgpl2-details"]),
    ("LGPL-2.0-or-later", ["lgpl2-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "lgpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope", "agpl-details", "agpl-received"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
]

_WORD = re.compile(r"\w+")
#: What ends a fragment: an end of a sentence, or (group 1) something less.
_END = re.compile(r"[.!?:;]+(?=\s|$)|([\n,()])")
#: The rest of a line that names its licence by identifiers and operators.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z][\w.+-]*(?<![.-])\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z][\w.+-]*(?<![.-])\)*)*)", re.I)
#: Words at which a known sentence may begin within a fragment.
_INNER = frozenset("distributed licensed permission redistribution redistributions released".split())
_NEGATION = re.compile(r"\b(?:not|never|no|without|cannot|isn|aren|wasn)\b", re.I)
SPDX = "spdx"


def normalised(sentence: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(sentence.lower()))


class Catalogue:
    """Known sentences, to be looked up by their words."""

    def __init__(self, sentences):
        self.known: dict[tuple[str, ...], str] = {}
        self.slots: dict[str, list[tuple[tuple[str, ...], tuple[str, ...], str]]] = {}  # by first word: words before and after the slot
        self.longest: dict[str, int] = {}  # by first word: words of the longest sentence
        self.begins: set[tuple[str, ...]] = set()  # what a known sentence begins with and goes on after
        for name, sentence in sentences:
            before, slot, after = (normalised(x) if k != 1 else x for k, x in enumerate(sentence.partition("{}")))
            if slot:
                self.slots.setdefault(before[0], []).append((before, after, name))
            else:
                self.known[before] = name
            size = len(before) + len(after) + SLOT * bool(slot)
            self.longest[before[0]] = max(self.longest.get(before[0], 0), size)
            self.begins.update(before[:k] for k in range(1, len(before) + bool(slot)))
        inner = sorted(_INNER & self.longest.keys())
        self.inner = re.compile(r"\b(?:" + "|".join(map(re.escape, inner)) + r")\b", re.I) if inner else None

    def name(self, words: list[str]) -> str | None:
        """The identifier of a sentence of just these words; one without a slot goes first."""
        if (found := self.known.get(tuple(words))) is not None:
            return found
        for before, after, name in self.slots.get(words[0], ()):
            if len(before) + len(after) <= len(words) <= len(before) + len(after) + SLOT and tuple(words[: len(before)]) == before and tuple(words[len(words) - len(after) :]) == after:
                return name
        return None

    def goes_on(self, words: list[str]) -> bool:
        """Whether a known sentence begins with these words and goes on, as some hold an end mark within."""
        return tuple(words) in self.begins or any(len(words) >= len(before) and tuple(words[: len(before)]) == before for before, _, _ in self.slots.get(words[0], ()))


@lru_cache(maxsize=4)
def catalogue(sentences: tuple[tuple[str, str], ...]) -> Catalogue:
    return Catalogue(sentences)


def fragments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a sentence ends there) of each fragment."""
    start = 0
    for m in _END.finditer(text):
        yield start, m.start(), m.group(1) is None
        start = m.end()
    if start < len(text):
        yield start, len(text), True


def _sentence(text: str, parts: list[tuple[int, int, bool]], k: int, at: int, known: Catalogue) -> tuple[str, int, int, int] | None:
    """The longest known sentence that begins at ``at``, within fragment k: (identifier, start, end, its last fragment)."""
    first = _WORD.search(text, at, parts[k][1])
    room = known.longest.get(first.group().lower(), 0) if first else 0
    found, words, j = None, [], k
    while room and j < len(parts):
        s, e, stop = parts[j]
        words += [m.group().lower() for m in islice(_WORD.finditer(text, max(s, at), e), room + 1 - len(words))]
        if len(words) > room:
            break
        if (name := known.name(words)) is not None:
            found = (name, first.start(), e, j)
        j += 1
        if stop and not known.goes_on(words):
            break
    return found


def identify(text: str | None, sentences: dict[str, str] = SENTENCES) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences of a text, in order, none within another."""
    if not text:
        return []
    known = catalogue(tuple(sentences.items()))
    parts = list(fragments(text))
    lines = [(m.start(), m.end()) for m in _SPDX.finditer(text)]
    inner = [m.start() for m in known.inner.finditer(text)] if known.inner else []
    out, k, line, place, done = [], 0, 0, 0, 0
    while k < len(parts):
        start, end, _ = parts[k]
        if line < len(lines) and lines[line][0] < end:  # no sentence has begun before it that goes on into it
            out.append((SPDX, *lines[line]))
            done = lines[line][1]
            line += 1
            while k < len(parts) and parts[k][1] <= done:
                k += 1
            while line < len(lines) and lines[line][0] < done:
                line += 1
            continue
        start = max(start, done)
        found = _sentence(text, parts, k, start, known)
        while place < len(inner) and inner[place] < start:
            place += 1
        if found is None and place < len(inner) and inner[place] < end:
            negation = _NEGATION.search(text, start, end)
            limit = negation.start() if negation else end
            while found is None and place < len(inner) and inner[place] < limit:
                found = _sentence(text, parts, k, inner[place], known)
                place += 1
        if found:
            out.append(found[:3])
            k = found[3]
            while line < len(lines) and lines[line][0] < found[2]:
                line += 1
        k += 1
    return out


@lru_cache(maxsize=4)
def _trie(rules: tuple[tuple[str, tuple[str, ...]], ...]):
    root: dict = {}
    for n, (_, ids) in enumerate(rules):
        node = root
        for i in ids:
            node = node.setdefault(i, {})
        node.setdefault(None, n)
    return root


def match(text: str | None, sentences: dict[str, str] = SENTENCES, rules=RULES, max_gap: int = MAX_GAP) -> list[dict]:
    """The findings in a text, in its order: license, rule (its number, -1: partial, -2: an SPDX line), sentences, start, end."""
    ids = identify(text, sentences)
    if not ids:
        return []
    trie = _trie(tuple((name, tuple(seq)) for name, seq in rules))
    out, k = [], 0
    while k < len(ids):
        node, best, j = trie, None, k
        while j < len(ids) and ids[j][0] in node and (j == k or len(_WORD.findall(text[ids[j - 1][2] : ids[j][1]])) <= max_gap):
            node = node[ids[j][0]]
            j += 1
            if None in node:
                best = (node[None], j)
        if ids[k][0] == SPDX:
            expression = " ".join(_SPDX.match(text, ids[k][1]).group(1).split())
            while expression.count(")") > expression.count("("):  # it stands in parentheses itself
                expression = "".join(expression.rsplit(")", 1))
            out.append({"license": expression, "kind": "rule", "rule": -2, "sentences": [SPDX], "start": ids[k][1], "end": ids[k][2]})
            k += 1
            continue
        rule, end = best or (-1, k + 1)
        name = rules[rule][0] if best else "|".join(sorted({n for n, seq in rules if ids[k][0] in seq})) or "unknown"
        out.append({"license": name, "kind": "rule" if best else "partial", "rule": rule, "sentences": [i for i, _, _ in ids[k:end]], "start": ids[k][1], "end": ids[end - 1][2]})
        k = end
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """A row for each finding: doc_id, n (from 0 within the text), license, kind, rule, sentences, start, end (code points)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("license", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("sentences", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            found = [{"doc_id": d, "n": n, **f} for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for n, f in enumerate(match(t.as_py(), sentences, rules, max_gap))]
            yield pa.RecordBatch.from_pylist(found, schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n int, license string, kind string, rule int, sentences array<string>, start long, end long")
