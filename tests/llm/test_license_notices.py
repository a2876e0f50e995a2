"""Notices of the GNU licences name their own licence."""

import random
import re
import time

import pytest

from relgrove.llm import licenses

HOPE = "is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU"
FREE = "is free software{0} you can redistribute it and/or modify\nit under the terms of the GNU {1} as published by\nthe Free Software Foundation{2} either version {3} of the License, or\n(at your option) any later version.\n\n"
G, L, A = "General Public License", "Lesser General Public License", "Affero General Public License"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This program " + FREE.format(";", G, ";", "2") + f"This program {HOPE} {G} for more details.\n\nYou should have received a copy of the GNU {G}\nalong with this program; if not, write to the Free Software Foundation, Inc.,\n51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.", "GPL-2.0-or-later"),
        ("This program " + FREE.format(":", A, ",", "3") + f"This program {HOPE} {A} for more details.\n\nYou should have received a copy of the GNU {A}\nalong with this program.", "AGPL-3.0-or-later"),
        ("This library " + FREE.format(";", L, ";", "2.1") + f"This library {HOPE} {L} for more details.", "LGPL-2.1-or-later"),
        ("This program " + FREE.format(":", G, ",", "3") + f"This program {HOPE} {G} for more details.\n\nYou should have received a copy of the GNU {G}\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.", "GPL-3.0-or-later"),
    ],
)
def test_notice(text, want):
    assert [(f["license"], f["kind"]) for f in licenses.match(text)] == [(want, "rule")]


def test_shared_sentences_name_all():
    (found,) = licenses.match(licenses.SENTENCES["gpl-hope"])
    assert found["kind"] == "partial" and found["license"] == "AGPL-3.0-or-later|GPL-2.0-only|GPL-2.0-or-later|GPL-3.0-or-later"


S = licenses.SENTENCES
BSD_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{0}
THIS SOFTWARE IS PROVIDED BY {1} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NAME = "\n3. Neither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
MIT_END = S["as-is-software"] + "  " + S["mit-liability"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT License\n\nCopyright (c) 2021 A. Body\n\n" + S["mit-grant"] + "\n\n" + S["mit-condition"] + "\n\n" + MIT_END, "MIT"),
        ("MIT No Attribution\n\nCopyright 2021 A. Body\n\n" + S["mit0-grant"] + "\n\n" + MIT_END, "MIT-0"),
        ("Copyright (c) 2021, A. Body\nAll of it.\n\n" + BSD_BODY.format("", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), "BSD-2-Clause"),
        ("BSD 3-Clause\n\n" + BSD_BODY.format(NAME.format("the copyright holder"), "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), "BSD-3-Clause"),
        (BSD_BODY.format(NAME.format("Example Inc."), "EXAMPLE INC. AND CONTRIBUTORS"), "BSD-3-Clause"),
        (BSD_BODY.format(NAME.format("the University of Somewhere, its schools,"), "THE REGENTS AND CONTRIBUTORS"), "BSD-3-Clause"),
        ("Copyright 2021 A. Body\n\n" + "\n".join(S[k] for k in ("isc-grant", "isc-warranty", "isc-liability")), "ISC"),
        ("# This file is licensed under the MIT License.", "MIT"),
        ("The code is released under the Apache License, Version 2.0, see the file.", "Apache-2.0"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */", "(GPL-2.0-only WITH Linux-syscall-note) OR MIT"),
        ("(SPDX-License-Identifier: Apache-2.0).", "Apache-2.0"),
    ],
)
def test_whole_texts_and_lines(text, want):
    for around in (text, f"Some words before.\n{text}\n\nAnd words after it.", text.replace("\n", "\r\n")):
        assert [(f["license"], f["kind"]) for f in licenses.match(around)] == [(want, "rule")]


@pytest.mark.parametrize("text", ["It is not licensed under the MIT License.", "We never released under the MIT License.", "SPDX-License-Identifier:", "spdx license identifier MIT", "a licence is a licence"])
def test_no_licence(text):
    assert licenses.match(text) == []


def test_another_condition_is_no_mit_0():
    text = S["mit-grant"] + "\n\nThe notice above shall be part of all copies that are made of it.\n\n" + MIT_END
    found = licenses.match(text)
    assert found[0]["license"] == "MIT" and {f["kind"] for f in found} == {"partial"} and all(f["license"] != "MIT-0" for f in found)


def test_very_long_texts():
    start = time.time()
    for text in ("word " * 400_000, "licensed " * 100_000, "Licensed under the. " * 50_000, "\n" * 500_000, "THIS SOFTWARE IS PROVIDED BY " * 20_000):
        assert licenses.match(text) == []
    assert len(licenses.match("Released under the MIT License.\n" * 20_000)) == 20_000
    assert time.time() - start < 60


def brute_identify(text, sentences):
    """By trying each sentence at each place."""
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    cut = [len(text) if k + 1 == len(words) else words[k + 1][1] for k in range(len(words))]
    ends = [k + 1 == len(words) or bool(re.search(r"[.!?:;]+\s|[\n,()]", text[words[k][2] : cut[k]])) for k in range(len(words))]

    def at(i):
        best = None
        for name, sentence in sentences.items():
            before, slot, after = (re.findall(r"\w+", x.lower()) if x != "{}" else x for x in sentence.partition("{}"))
            for gap in range(licenses.SLOT + 1) if slot else [0]:
                n = len(before) + gap + len(after)
                own = [w for w, _, _ in words[i : i + n]]
                if len(own) == n and ends[i + n - 1] and own[: len(before)] == before and own[n - len(after) :] == after and (best is None or (n, not slot) > best[:2]):
                    best = (n, not slot, name)
        return best

    out, i = [], 0
    while i < len(words):
        stop = next(k for k in range(i, len(words)) if ends[k])
        for j in range(i, stop + 1):
            if j == i or words[j][0] in ("licensed", "released") and not {"not", "no"} & {w for w, _, _ in words[i:j]}:
                if found := at(j):
                    out.append((found[2], words[j][1]))
                    stop = j + found[0] - 1
                    break
        i = stop + 1
    return out


def test_sentences_by_brute_force():
    rng = random.Random(9)
    sentences = {"a": "licensed under x", "b": "licensed under x. or y", "c": "this is x", "d": "this is x, licensed under y", "e": "x {} y x", "f": "released", "g": "y", "h": "no {}: x"}
    seen = set()
    for _ in range(3000):
        pieces = [*"licensed under x y or this is released no z".split(), *(s.replace("{}", rng.choice(["", "z", "x or"])) for s in sentences.values())]
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", ": ", ".", " ("]) for _ in range(rng.randrange(1, 22)))
        got = [(name, start) for name, start, _ in licenses.identify(text, sentences)]
        assert got == brute_identify(text, sentences), text
        seen |= {name for name, _ in got}
    assert seen == set(sentences)
