"""The ten operators against brute force, round trips and held-out accuracy, on small fixtures with the odd cases of each."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkfolio.llm import chat, common, exact, gam, jaccard, langid, licences, packing, placement, queries, secrets, tiling

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one", "one two", "One  TWO", "a b c d e", "a b c d e", "é ß 漢字 x y z", "x" * 3000]
    base = [" ".join(rng.choices(WORDS, k=rng.choice([6, 20, 60, 200]))) for _ in range(n)]
    for t in base:
        out.append(t)
        for _ in range(rng.choice([0, 1, 3])):
            w = t.split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def frame(spark, items, extra=True):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(items)] + ([(None, "null id a b c d", None, None, None), (3, "one", None, None, None)] if extra else [])
    return spark.createDataFrame(rows, SCHEMA)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_jaccard_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CHUNK", 3 if block == 2 else jaccard.CHUNK)
    items = texts(40) + [" ".join(f"q{i}" for i in range(n)) for n in range(5, 20)]
    got = {r.doc_id: r for r in jaccard.near_duplicates(frame(spark, items)).collect() if r.doc_id is not None}
    sets = [shingles(t) for t in items]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert {i: got[i].component_id for i in range(len(items))} == {i: find(i) for i in range(len(items))}
    assert [got[i].n_shingles for i in range(len(items))] == [len(s) for s in sets]


def test_signatures_of_linked_sets_meet():
    rng = random.Random(5)
    rank = np.zeros(jaccard.COUNTERS, np.uint64)
    for _ in range(300):
        n = rng.choice([4, 5, 7, 8, 10, 12, 13, 14, 18, 30, 100])
        one = rng.sample(range(10**9), n)
        lost = [x for x in range(n + 1) if 4 * (n - x) >= 3 * n]
        two = one[rng.choice(lost) :]
        while True:
            more = [*two, rng.randrange(10**9, 2 * 10**9)]
            if 4 * len(set(one) & set(more)) < 3 * len(set(one) | set(more)):
                break
            two = more
            if rng.random() < 0.3:
                break
        signs = []
        for x in (one, two):
            values = np.sort(common.mix(np.array(x, np.uint64)))
            got = [s if lost is None else jaccard.rarest(s, r, lost, rank)[0] for s, r, lost in jaccard.signatures(values, np.array([0, len(x)]))]
            signs.append(set(np.concatenate(got).tolist()) if got else set())
        assert set(one) == set(two) or signs[0] & signs[1], (n, len(two))


def test_subsets_of_three_parts_are_enumerated():
    assert [jaccard.instance(h) for h in (2, 4, 9, 13, 18, 300)] == [(0, 1, 0), (1, 4, 1), (1, 5, 2), (1, 6, 3), (64, 1, 0), (1024, 1, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = queries.vocabulary()
    made = [licences.scan(none), tiling.contamination(none, bench), tiling.clean(none, bench), packing.pack(none, path), gam.score(none, labels), placement.place(none, "doc_id", [0, 0, 0]), jaccard.near_duplicates(none), secrets.digest(secrets.scan(none)), langid.identify(none), exact.exact_duplicates(none), chat.digest_chats(chat.format_chats(chats))]
    assert [df.count() for df in made] == [0] * len(made)


def test_exact_keeps_longest_then_first(spark):
    items = ["a b", "ab", "a  b", "a  b", None, "", " ", "c"]
    rows = exact.exact_duplicates(frame(spark, items, extra=False)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == {0: (2, 4, False), 1: (2, 4, False), 2: (2, 4, True), 3: (2, 4, False), 4: (6, 3, False), 5: (6, 3, False), 6: (6, 3, True), 7: (7, 1, True)}
    assert {r.text_sha256 for r in rows if r.doc_id < 4} == {hashlib.sha256(b"ab").hexdigest()}
    twice = exact.exact_duplicates(spark.createDataFrame([(1, "x")] * 3, "doc_id long, text string")).collect()
    assert sorted(r.kept for r in twice) == [False, False, True]


def test_perfect_hash_is_minimal_and_checks_bytes():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(1000)), np.uint64).reshape(-1, 4)
    levels, slots = exact.build(keys[:900])
    assert sorted(slots) == list(range(900))
    table = keys[:900][np.argsort(slots)]
    assert (exact.look_up(levels, table, keys)[:900] == slots).all() and (exact.look_up(levels, table, keys)[900:] == -1).all()


@pytest.mark.parametrize("seed", range(5))
def test_dominance_and_best_fit(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 40), rng.randint(30, 100)]) for _ in range(300))
    plan = packing.plan(dict(counts), 100)
    assert sum((Counter({k: v * n for k, v in Counter(f).items()}) for f, n, _ in plan), Counter()) == counts
    assert all(sum(f) <= 100 for f, _, _ in plan)
    used, bound = sum(n for _, n, _ in plan), -(-sum(k * v for k, v in counts.items()) // 100)
    assert bound <= used <= max(bound + 2, sum(n for _, n in packing.best_fit(dict(counts), 100)))


def test_reduction_keeps_the_optimum():
    def best(items, size):
        items = sorted(items, reverse=True)
        low = [len(items)]

        def go(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for b in {x: k for k, x in enumerate(bins)}.values():
                if bins[b] + items[i] <= size:
                    go(i + 1, [x + items[i] * (k == b) for k, x in enumerate(bins)])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return low[0]

    for seed in range(60):
        rng = random.Random(seed)
        items = [rng.randint(1, 20) for _ in range(9)]
        instance = packing.Instance(dict(Counter(items)))
        fixed = packing.reduce(instance, 20)
        assert sum(n for _, n in fixed) + best(list(Counter(instance.counts).elements()), 20) == best(items, 20)


def test_packing_rows(spark):
    from tokenizers import Tokenizer

    items = [None, "", "short text", "short text", "<|endoftext|> it's\n\n  ünï", "word " * 5000]
    rows = packing.pack(frame(spark, items), queries.vocabulary()).collect()
    own = Tokenizer.from_file(queries.vocabulary())
    for i, t in enumerate(items):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == i and not (i == 3 and r.length == 2)), key=lambda r: r.piece)
        assert [r.length for r in mine] == ([len(ids)] if len(ids) <= 2048 else [len(ids) % 2048 or 2048] + [2048] * ((len(ids) - 1) // 2048))
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def same_ids(spark, items):
    """Whether one-piece and cut texts have the ids of tokenizers as the file sets it, and add_special_tokens=False."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary())
    ids = [[*own.encode(t or "", add_special_tokens=False).ids, 0] for t in items]
    rows = packing.pack(frame(spark, items, extra=False), queries.vocabulary()).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in map(sorted, held.values()):
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 2048
    assert Counter({i: len(x) for i, x in enumerate(ids)}) == sum((Counter({r.doc_id: r.length}) for r in rows), Counter())
    return ids, all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)


def test_packing_takes_added_tokens(spark):
    ids, same = same_ids(spark, ["a <|endoftext|> b", "<|endoftext|> it's\n\n  ünï", "<|endoftext|><|endoftext|>", None, "", "short text", "short text", "word <|endoftext|> " * 1000])
    assert same and ids[0] == [64, 220, 50256, 275, 0]


@pytest.mark.parametrize("run", [" ", "\n"])
def test_packing_takes_long_runs_of_white_space(spark, run):
    assert same_ids(spark, ["a" + run * 1_100_000 + "b", run * 1_000_001])[1]


def test_encoder_gives_the_ids_of_whole_texts():
    own, rng = packing.Encoder(queries.vocabulary()), random.Random(1)
    parts = ["a", "b", "'s", "'S", "'ll", " ", "  ", "\n", "\r", "\t", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "é", "ß", "Ж", "א", "ا", "漢", "カ", "ー", "각", "α", "ς", "ǆ", "ª", "µ", "×", "٣", "1", "!", "😀", "\u0301", "<|endoftext|>", "<|endof"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert own.ids(text) == own.whole(text), repr(text)
    assert own.splits


@pytest.mark.parametrize("mark", [" ", "\n", "a", "!", "é", "漢"])
def test_encoder_takes_long_texts(mark):
    own = packing.Encoder(queries.vocabulary())
    assert own.ids(mark * 1_000_000) == own.whole(mark * 1_000_000)


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<s><s>[/NAME]", "", None, "a\nb [SYS", "漢字😀"]
    rows = [(1, i, ["user", "assistant", "system", None, "tool"][i % 5], t) for i, t in enumerate(odd)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (None, None, "user", "n")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in made.select("conv_id", "valid", "wrong", chat.read_back(made.formatted).alias("t")).collect()}
    assert [(t.role, t.text) for t in back[1].t] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert [t.loss for t in back[1].t] == [r == "assistant" for _, _, r, _ in rows[:8]]
    assert (back[1].valid, back[2].wrong, back[None].valid) == (False, 1, True)


def test_placement_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    table = placement.lookup_table(names, 2003)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = placement.lookup_table(names[:-1], 2003)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 19) < 0.15 * 2003
    with pytest.raises(ValueError):
        placement.lookup_table(names, 2000)


def test_secret_queries_and_spans(spark):
    assert secrets.trigram_query(secrets.RULES["hex"][0]) is None
    assert frozenset({"aki", "kia"}) in secrets.trigram_query(secrets.RULES["access"][0])
    items = [None, "", "é token = 'abcdef' secret: token: abcdefgh", "AKIA" + "A" * 16 + " AKIAshort", "0123456789abcdef01234567", "api_key=12345", "PassWord:xxxxxxx " + "f" * 30, "-----BEGIN RSA PRIVATE KEY-----"]
    docs = frame(spark, items, extra=False).union(spark.createDataFrame([(None, "plain", None, None, None)], SCHEMA))
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    rules = [("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    for i, t in enumerate(items):
        base = sorted((m.start(), k, m.end(), name) for k, (name, x, g, n) in enumerate(rules) for m in re.finditer(x, t or "") if len(m[g]) >= n)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in base).encode()).hexdigest()
    assert got[7].spans == "pem:0:31" and got[None].spans == ""


def test_licences(spark):
    items = ["Released under the MIT License.", "X. Licensed under the Apache License, Version 2.0. You may not use this file!", "Some licence of ours.", None, "", "a" * 5000]
    got = {r.doc_id: (r.licences, r.n_matches, r.n_known, r.n_unknown) for r in licences.scan(frame(spark, items, extra=False)).collect()}
    assert got == {0: ("MIT", 1, 1, 0), 1: ("Apache-2.0", 1, 1, 0), 2: ("", 0, 0, 1), 3: ("", 0, 0, 0), 4: ("", 0, 0, 0), 5: ("", 0, 0, 0)}


APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Jane Doe

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("way", ["wrapped", "commented", "starred", "one line"])
def test_licences_of_real_notices(spark, way):
    change = {"wrapped": str, "commented": lambda t: re.sub("(?m)^", "# ", t), "starred": lambda t: "/*\n" + re.sub("(?m)^", " * ", t) + "\n */", "one line": lambda t: " ".join(t.split())}[way]
    held = BSD.replace("the copyright holder nor", "Example Systems, Inc. nor")
    two = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
    lettered = BSD.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ")
    items = [f"Some words before.\n\n{change(t)}\n\nSome words after." for t in (APACHE, MIT, BSD, held, two, lettered, GPL, MPL, APACHE.replace("http:", "https:"), f"{MIT}\n\n{GPL}")]
    got = {r.doc_id: (r.licences, r.sequences) for r in licences.scan(frame(spark, items, extra=False)).collect()}
    three = ("BSD-3-Clause", "RSTU")
    assert got == {0: ("Apache-2.0", "ABCDE"), 1: ("MIT", "NO"), 2: three, 3: three, 4: ("BSD-2-Clause", "RST"), 5: three, 6: ("GPL-3.0-or-later", "HIJ"), 7: ("MPL-2.0", "X"), 8: ("Apache-2.0", "ABCDE"), 9: ("GPL-3.0-or-later,MIT", "NO HIJ")}


MORE = {
    "GPL-2.0-or-later": GPL.replace("version 3", "version 2"),
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.",
    "EPL-2.0": "// SPDX-License-Identifier: EPL-2.0",
    "MIT": "/* SPDX-License-Identifier: MIT */",
    "GPL-2.0-only": "# SPDX-License-Identifier: GPL-2.0-only\nimport os",
}


def test_more_licences(spark):
    items = [f"Some words before.\n\n{t}\n\nSome words after." for t in MORE.values()]
    got = {r.doc_id: r.licences for r in licences.scan(frame(spark, items, extra=False)).collect()}
    assert got == dict(enumerate(MORE))


def test_licences_keep_short_sentences_apart(spark):
    items = ["This work is licensed under the GNU General Public License version 3 or any later version.", "It was never released under the MIT License\nat all.", "Released under the\n MIT License."]
    assert [r.licences for r in licences.scan(frame(spark, items, extra=False)).orderBy("doc_id").collect()] == ["", "", "MIT"]


def brute_tiles(doc, item, size=5):
    free_d, free_i, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return total
        total += n
        for k in range(n):
            free_d[i + k] = free_i[j + k] = False


def test_tiling_equals_brute_force_and_join(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choices("abcdefgh", k=rng.choice([3, 12, 30]))) for _ in range(8)]
    docs = [None, ""]
    for t in items:
        w = t.split()
        docs += [t.upper() + ".", " ".join(w[len(w) // 2 :] + ["zz"] + w[: len(w) // 2]), " ".join(rng.choices("abcdefgh", k=40)), " ".join(rng.sample(w, len(w)))]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, None)], "item_id long, text string")
    df = frame(spark, docs, extra=False)
    want = set()
    for d, t in enumerate(docs):
        for m, item in enumerate(items):
            w = re.findall("[a-z]+", (t or "").lower())
            covered = brute_tiles(w, item.split())
            if len(item.split()) >= 5 and covered >= 0.75 * len(item.split()):
                want.add((d, m, covered))
    assert {(r.doc_id, r.item_id, r.covered) for r in tiling.contamination(df, bench).collect()} == want
    assert {(r.doc_id, r.item_id, r.covered) for r in tiling.by_join(df, bench).collect()} == want
    assert {r.doc_id for r in tiling.clean(df, bench).collect()} == set(range(len(docs))) - {d for d, _, _ in want}


@pytest.mark.parametrize("most", [tiling.MOST_WORDS, 0])
def test_clean_judges_rows_on_both_paths(spark, monkeypatch, most):
    monkeypatch.setattr(tiling, "MOST_WORDS", most)
    passage = "one two three four five six seven"
    rows = [(None, passage), (None, "clean without id"), (None, None), (1, f"x {passage} y"), (1, "clean of the same id"), (1, "clean of the same id"), (2, passage), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(0, passage), (None, None)], "item_id long, text string")
    assert (tiling.broadcastable(bench) is None) == (most == 0)
    got = tiling.clean(df, bench)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, t) for i, t in rows if passage not in (t or ""))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = gam.score(common.table(spark, folder, "documents"), common.table(spark, folder, "labels")).join(common.table(spark, folder, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert not np.isnan(gam.features(pa.array([None, "", " ", "x"]))).any()


def test_language_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, None, None), (-2, "123 !!", None), (-3, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.union(more)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if got[d].held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert {(got[d].lang_pred, got[d].score) for d in (-1, -2, -3)} == {("und", 0.0)}


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, FOLDER)
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(map(str, (tuple(r[c] for c in sorted(names)) for r in df.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()))), name


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = common.table(spark, FOLDER, "documents")
    doubled = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None)], SCHEMA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, doubled, FOLDER)
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= doubled.count(), name
    assert corpus_pipeline.exact_dedup(spark, doubled, FOLDER).filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count() == 0
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0


def stage(spark, name, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, df, FOLDER)
    assert out.columns == df.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_near_dedup_decides_for_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    # a near copy and a unique text share id 5, two near copies share id 7
    rows = [(1, a), (5, a + " more"), (5, b), (7, c), (7, c + " more"), (None, a), (8, None), (8, "")]
    got = stage(spark, "near_dedup", rows)
    assert [x for x in got if x[0] == 7] and sum(n for (i, _), n in got.items() if i == 7) == 1
    assert Counter({x: n for x, n in got.items() if x[0] != 7}) == Counter([(1, a), (5, b), (None, a), (8, None), (8, "")])


def test_exact_dedup_decides_for_rows(spark):
    assert stage(spark, "exact_dedup", [(1, "x y"), (None, "xy"), (2, "z")]) == Counter([(1, "x y"), (2, "z")])
    rows = [(1, "x y"), (None, "xy"), (3, "other"), (3, "x y"), (4, "q"), (4, "q "), (None, "only"), (None, "only"), (None, "another")]
    assert stage(spark, "exact_dedup", rows) == Counter([(1, "x y"), (3, "other"), (4, "q "), (None, "only"), (None, "another")])


CLASHES = ["row", "number", "sha", "node", "key", "id", "a", "b", "digest", "length", "piece", "kinds", "m0", "found", "slot", "component_id", "x", "y", "h", "lettered", "salt", "_row"]


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h i"), (None, "token = abcdefgh"), (3, None), (4, "")]
    plain = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    more = plain.selectExpr("*", *(f"'kept' AS `{c}`" for c in CLASHES))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS h", "2 AS y")
    bench = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string").selectExpr("*", "1 AS seed", "2 AS key")
    path = queries.vocabulary()
    made = [licences.scan, lambda d: tiling.contamination(d, bench), lambda d: packing.pack(d, path).drop("sequence_id", "offset"), lambda d: gam.score(d, labels), jaccard.near_duplicates, lambda d: secrets.digest(secrets.scan(d)), langid.identify, exact.exact_duplicates, lambda d: placement.place(d, "doc_id", [0, 1, 0]).select("doc_id", "slot", "shard")]
    for f in made:
        assert sorted(map(str, f(plain).collect())) == sorted(map(str, f(more).collect()))
    chats = spark.createDataFrame([(1, 0, "user", "x", "kept", "kept")], "conv_id long, turn long, role string, text string, rows string, segments string")
    assert chat.format_chats(chats).first().formatted == "[INST]x[/INST]"
    for name, stage_ in corpus_pipeline.STAGES[:-1]:
        got = stage_(spark, more, FOLDER)
        assert got.columns == more.columns
        assert got.filter(" OR ".join(f"`{c}` <> 'kept'" for c in CLASHES)).count() == 0, name
