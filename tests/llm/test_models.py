"""Scores, languages, quality, personal data, licenses and benchmark leaks against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from .odd_rows import ODD
from pyspark.sql import functions as F

from tapeframe.llm import arrays, decontaminate, hmm, language, licenses, pii, quality

SF = "/root/testdata/sf0.001"


def held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 0


# Language-model scores


def brute_log10(model, symbols):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[path[0], symbols[0]]
        for a, b, s in zip(path, path[1:], symbols[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    return math.log10(total)


def a_model(k, m, seed=0):
    r = np.random.default_rng(seed)
    share = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(share(r.random(k)), share(r.random((k, k))), share(r.random((k, m))))


def test_forward_is_the_sum_over_paths():
    model, r = a_model(3, 5), np.random.default_rng(1)
    lengths = np.array([1, 4, 2, 6, 1])
    symbols = r.integers(0, 5, lengths.sum())
    first = np.cumsum(lengths) - lengths
    want = [brute_log10(model, symbols[a:a + n]) for a, n in zip(first, lengths, strict=True)]
    assert model.log10(symbols, lengths) == pytest.approx(want)


def test_training_never_lowers_the_likelihood():
    model, r = a_model(3, 6), np.random.default_rng(2)
    lengths = r.integers(1, 30, 40)
    symbols = (np.cumsum(r.integers(0, 2, lengths.sum())) % 6)
    last, k = -np.inf, 3
    share = lambda x: x / x.sum(-1, keepdims=True)
    for _ in range(8):
        v = model.expected(symbols, lengths)
        assert v[-1] >= last - 1e-9
        assert v[:k].sum() == pytest.approx(len(lengths)) and v[k + k * k:-1].sum() == pytest.approx(lengths.sum())
        last = v[-1]
        model = hmm.Model(share(v[:k]), share(v[k:k + k * k].reshape(k, k)), share(v[k + k * k:-1].reshape(k, -1)))


def test_base_scores(docs_of, odd, none):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["The", "the", "a", "É", "x\ty", "dog."], k=rnd.randint(0, 9)))) for i in range(60)] + [(99, None)]
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for i, t in rows}
    counts = collections.Counter(x for i, own in tokens.items() if not held(i, 10) for x in own)
    n, v = sum(counts.values()), len(counts)
    got = hmm.score(docs_of(rows), hmm.ModelConfig(states=2, rounds=2, classes=8)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 10), len(own), sum(counts[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own))
        assert r.score < 0
    assert hmm.score(odd, hmm.ModelConfig(rounds=1)).count() == len(ODD)
    assert hmm.score(none, hmm.ModelConfig(rounds=1)).count() == 0


def test_held_out_text_is_likelier_than_by_the_base(spark):
    got = hmm.score(spark.read.parquet(f"{SF}/documents.parquet"), hmm.ModelConfig(rounds=4)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# Languages and quality


def test_language(spark, docs_of, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    rows = language.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"} and {r.lang_pred for r in rows if r.doc_id == 4} == {"en"}
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(docs_of([(1, "abc", None), (2, "def", None)])).collect()} == {"und"}


def test_bundles_add_and_bind():
    config = language.ProfileConfig(dimensions=100)
    bundle, letters = language.bundles(pa.array(["ab ab", "ab", "", "1 2"], pa.large_string()), config)
    assert letters.tolist() == [4, 2, 0, 0]
    assert (bundle[0] == 2 * bundle[1]).all() and not bundle[2:].any()
    a, b, edge = language.letter_vectors(np.array([97, 98, 0]), config).astype(int)
    assert (bundle[1] == np.roll(edge, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * edge).all()


def plain_bundle(text, config):
    """One word and one letter at a time."""
    total = np.zeros(config.dimensions)
    vector = lambda c: language.letter_vectors(np.array([c]), config)[0].astype(int)
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        codes = [0, *map(ord, word), 0]
        for x, y, z in zip(codes, codes[1:], codes[2:], strict=False):
            total += np.roll(vector(x), 2) * np.roll(vector(y), 1) * vector(z)
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcé漢字 1.\n", max_size=40), min_size=1, max_size=5), st.integers(1, 9))
def test_bundles_in_blocks_are_the_plain_ones(texts, block):
    config = language.ProfileConfig(dimensions=70)
    got, letters = language.bundles(pa.array(texts, pa.large_string()), config, block)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    assert (got == np.stack([plain_bundle(t, config) for t in texts])).all()


def test_predictions_are_the_plain_ones(docs_of):
    """Learning and prediction one text at a time, on every text of a small table."""
    rnd = random.Random(4)
    syllables = {"x": ["ka", "to", "mi"], "y": ["sch", "ung", "ein"], "z": ["漢", "字", "語"]}
    rows = [(i, " ".join("".join(rnd.choices(syllables[g], k=3)) for _ in range(rnd.randrange(1, 9))), g) for i, g in enumerate(rnd.choices("xyz", k=60))]
    rows += [(100, "kato schung", None), (101, "123", "x"), (102, None, "y"), (None, "kami tomi", "x")]
    config = language.ProfileConfig(dimensions=90)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    profiles = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not held(i):
            profiles[lang] = profiles.get(lang, 0) + plain_bundle(text, config)
    for r in language.identify(docs_of(rows), config).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        own = plain_bundle(text or "", config)
        assert r.held_out == held(r.doc_id)
        if not own.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in sorted(profiles.items())}
        best = max(cosine, key=cosine.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0, cosine[best]), abs=1e-5)


def test_large_alphabets_take_little_memory():
    rnd = random.Random(6)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(300_000))
    tracemalloc.start()
    language.bundles(pa.array([text], pa.large_string()), language.ProfileConfig())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85 and all(0 <= r.score <= 1 for r in got)
    assert len(quality.score(odd, labels).collect()) == len(ODD)
    assert quality.score(none, labels).count() == 0
    assert {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.clean(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0.1, 5)), min_size=1, max_size=25))
def test_isotonic(points):
    y, w = (np.array(x) for x in zip(*points, strict=True))
    fitted = quality.isotonic(y, w)
    assert (np.diff(fitted) >= -1e-12).all()
    assert np.dot(fitted, w) == pytest.approx(np.dot(y, w))
    for level in set(fitted.tolist()):
        assert level == pytest.approx(np.average(y[fitted == level], weights=w[fitted == level]))


# Personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only(s):
    return re.sub("[^0-9]", "", s)


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(only(s)) <= 19 and luhn(only(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
)


def base_spans(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m.group(0))] for k, p, ok in RULES]


PIECES = ["a@b.c", "@", "x.y@", "@z.org", "1.2.3.4", "256.1.1.1", "001.02.3.255", ".5", "4111 1111 1111 1111", "4111111111111111", "1234567890123",
          "+1 (988) 555-2485", "+12", "+", "-", " ", " ", "é", "😀", "9", "00", "mail ", "..", "(555) 123-4567", "joe [at] site [dot] com", "\n"]


def test_base_spans(docs_of):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choices(PIECES, k=rnd.randint(0, 14)))) for i in range(400)]
    for r in pii.digest(docs_of(rows)).collect():
        want = base_spans(rows[r.doc_id][1])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want], rows[r.doc_id]
        flat = [x for own in want for x in own]
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest(), rows[r.doc_id]
        assert set(flat) <= set(r.spans.split(",")) | {""}


def test_looser_spans_are_added(docs_of):
    rows = [(i, f"mail to user{i}@mail.example.com or call +1 212 555 01{i:02}") for i in range(50)]
    rows += [(100, "please call (212) 555-0199 today"), (101, "mail joe [at] site [dot] com now")]
    got = {r.doc_id: r.spans for r in pii.digest(docs_of(rows)).collect()}
    assert got[100] == "phone:12:26" and got[101] == "email:5:28"


def test_odd_spans(odd, none, docs_of):
    got = pii.digest(odd).collect()
    assert len(got) == len(ODD) and {r.spans for r in got} == {""}
    assert pii.digest(none).count() == 0
    hard = "7" * 60_000 + " " + "a" * 60_000 + "@ " + "1." * 30_000 + " +" + "(" * 60_000 + " x@y" + ".z" * 30_000
    (row,) = pii.digest(docs_of([(1, hard)])).collect()
    want = base_spans("1." * 30_000)
    assert (row.n_email, row.n_ip) == (1, len(want[1]))


def test_estimate_ranks_patterns():
    rows = [dict(kind="phone", size=1, strict=s, gazetteer=g, context=0, edges=e, n=n)
            for s, g, e, n in ((1, 1, 1, 500), (1, 0, 1, 80), (-1, 0, -1, 300), (-1, -1, -1, 200), (0, 0, 1, 20))]
    p = pii.estimate(rows)
    assert p[0] > 0.9 and p[3] < 0.1 and p[0] >= p[1] > p[2]


# Licenses


def test_licenses(docs_of, odd, none):
    words = dict(licenses.SENTENCES)
    header = ". ".join(words[s].replace(" ", "\n", 3) for s in ("apache2-the-license", "apache2-copy", "apache2-as-is", "apache2-see"))
    rows = [(1, "Intro\nReleased under the MIT License.\nMore. Released under the MIT license. x"), (2, header), (3, "permission to copy"),
            (4, "Licensed under the Apache License, Version 2.0."), (5, words["mpl2-copy"])]
    got = sorted(tuple(r) for r in licenses.scan(docs_of(rows)).collect())
    assert got == [(1, "mit-released-notice", "MIT", 2), (2, "apache2-header", "Apache-2.0", 1), (4, "apache2-notice", "Apache-2.0", 1)]
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert all(re.search("|".join(licenses.NEEDED), w) for w in words.values())
    assert all(set(seq) <= set(words) for _, _, seq in licenses.RULES)


NOTICES = {
    "apache2-header": """Copyright 2024 A. Author and others

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "mit-text": """MIT License

Copyright (c) 2024 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "gpl3-header": """# Copyright (C) 2024  A. Author
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
""",
    "mpl2-header": """/* Copyright 2024 A. Author
 * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "bsd3-text": """Copyright (c) 2024, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

(b) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "isc-grant-only": """Copyright 2024 A. Author
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
}


def test_licenses_as_published(docs_of):
    got = [(r.doc_id, r.rule, r.matches) for r in licenses.scan(docs_of(list(enumerate(NOTICES.values())))).collect()]
    assert sorted(got) == [(i, rule, 1) for i, rule in enumerate(NOTICES)]
    known = dict(licenses.SENTENCES + licenses.MORE_SENTENCES)
    assert all(any(re.search("|".join(licenses.NEEDED), known[s]) for s in seq) for _, _, seq in licenses.MORE_RULES)


# Benchmark leaks


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=60))
def test_edit_distance(pattern, text):
    want = plain_distance(pattern, text)
    assert decontaminate.distance_within(pattern, text, 99) == want
    assert want == 0 or decontaminate.distance_within(pattern, text, want - 1) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB9 .é\n漢", max_size=30), min_size=1, max_size=5))
def test_normal_texts(texts):
    out, at = decontaminate.normal(arrays.plain_texts(pa.array(texts, pa.large_string()), lower=True))
    want = ["".join(w + " " for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())) for t in texts]
    assert [out[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_walks_that_share_a_repetition_agree():
    config = decontaminate.LeakConfig()
    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog and runs away from it all the way home ", np.uint8)
    start = np.arange(20)
    _, both, _ = decontaminate.walk(text, start, [24, 48], 1, config)
    _, alone, _ = decontaminate.walk(text, start, [24], 1, config)
    assert (both[24] == alone[24]).all() and (both[24] >> np.uint64(32) == both[48] >> np.uint64(32)).all()
    seen = np.zeros(1 << 20, bool)
    seen[decontaminate._slot(both[24] >> np.uint64(32))[[3, 7]]] = True
    kept, some, _ = decontaminate.walk(text, start, [24, 48], 1, config, seen)
    assert {3, 7} <= set(kept.tolist()) and (some[48] == both[48][kept]).all()


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.18])
def test_recall_of_edited_items(spark, share):
    """Items of the small table with so many characters replaced, each inside other text."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    rnd, stock = random.Random(12), [f"w{i}" for i in range(2000)]
    found = total = 0
    made = decontaminate.Benchmark(items, decontaminate.LeakConfig())
    for _ in range(3):
        docs = []
        for _, text in items:
            out = list(text)
            for i in rnd.sample(range(len(out)), int(share * len(out))):
                out[i] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
            docs.append(f"{' '.join(rnd.choices(stock, k=50))} {''.join(out)} {' '.join(rnd.choices(stock, k=50))}")
        got = {(d, i) for d, i, _ in made.find(arrays.plain_texts(pa.array(docs, pa.large_string()), lower=True))}
        for d, (item_id, text) in enumerate(items):
            norm = lambda t: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()))
            if decontaminate.distance_within(norm(text), norm(docs[d]), int(0.2 * len(norm(text)))) is not None:
                total, found = total + 1, found + ((d, item_id) in got)
    assert total >= 100 and found >= 0.9 * total


def test_leaks(spark, docs_of, odd, none):
    rnd = random.Random(8)
    stock = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rnd.choices(stock, k=n))
    items = [(i, text(rnd.choice([1, 2, 5, 9, 20, 40, 70]))) for i in range(60)] + [(7, text(30)), (900, None), (901, ""), (902, "...")]
    rows, want = [], set()
    for d, (i, t) in enumerate(items[:60]):
        rows.append((d, f"{text(40)}. {(t or '').upper()}! {text(30)}"))
        want.add((d, i))
    for d, (i, t) in enumerate(items[:60]):
        own = t.split()
        if len(own) >= 20:
            own[rnd.randrange(len(own))] = "edited"
            rows.append((100 + d, f"{text(10)} {' '.join(own)} {text(10)}"))
            want.add((100 + d, i))
    rows += [(1000 + d, text(200)) for d in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for config in (decontaminate.LeakConfig(), decontaminate.LeakConfig(block_bytes=500)):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs_of(rows), benchmark, config).collect()}
        assert want <= set(got) and all(got[d, i] == 0 for d, i in want if d < 100)
        norm = {d: " ".join(re.findall(r"\w+", t.lower())) for d, t in rows}
        for d, i in set(got) - want:
            assert any(plain_distance(t, norm[d]) <= 0.2 * len(t) for j, t in items if j == i and t)
    kept = {r.doc_id for r in decontaminate.clean(docs_of(rows), benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.matches(odd, benchmark).count() == 0 and decontaminate.clean(odd, benchmark).count() == len(ODD)
    assert decontaminate.matches(none, benchmark).count() == 0
    assert decontaminate.clean(docs_of(rows), benchmark.limit(0)).count() == len(rows)
    copies = [(d, items[20][1]) for d in (1, 2, 2, None)]
    assert len(decontaminate.matches(docs_of(copies), benchmark.where("item_id = 20")).collect()) == 4


def test_word_hashes_depend_on_content_alone():
    texts = pa.array(["one two one", "two", "", "x" * 70_000 + " one"], pa.large_string())
    raw, at = arrays.buffers(texts)
    row, start, end = arrays.spans(raw, at, arrays.ALNUM)
    key = arrays.span_hashes(raw, start, end)
    assert row.tolist() == [0, 0, 0, 1, 3, 3]
    assert key[0] == key[2] == key[5] and key[1] == key[3] and len(set(key.tolist())) == 3
