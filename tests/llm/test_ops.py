"""Each text operator against a plain version, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from arealis.llm import decontamination, exact_dedup, license_scan, line_dedup, ngram_join, packing, quality, suffix_dedup, token_files, toxicity, word_counts
from arealis.llm.common import connected_components, crc_held_out
from arealis.llm.signature_tree import Sketch, bitmap, possible_links, width_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, component long, local string"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["ab", "cde", "fghi", "jk", "lmnop", "qr", "stu", "vwx", "Yz", "É"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(0, 160)) for _ in range(40)]
    shared = [prose(rng, 14) for _ in range(3)]
    rows = [(i, t + "\n" + rng.choice(shared) + "\n" + prose(rng, 9)) for i, t in enumerate(texts)]
    rows += [(100 + i, rows[i][1]) for i in range(6)]
    rows += [(200 + i, rows[i][1].replace("ab1 ", "zz ", 1) + " tail") for i in range(6)]
    return [*rows, (300, None), (301, ""), (302, " \t "), (303, "one two"), (304, "ONE  two"), (None, rows[0][1]), (None, None), (305, rows[3][1].replace(" ", "\t")), (7, rows[7][1]), (306, prose(rng, 4000))]


def by_row(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_exact_duplicates(spark, corpus):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in corpus:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want[i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert by_row(exact_dedup.exact_duplicates(frame(spark, corpus)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_trie_spills_by_subtree():
    rng = random.Random(4)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    trie = exact_dedup.PatriciaTrie(budget=2000)
    for i, k in enumerate(keys):
        trie.insert(k, i, 1, i)
    got = {}
    for key, (smallest, rows, tags) in trie.close():
        assert key not in got
        got[key] = (smallest, rows, sorted(tags))
    want = defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    assert got == {k: (min(v), len(v), v) for k, v in want.items()}


def plain_lines(rows):
    held = defaultdict(set)
    key = lambda line: line.strip(SPACE).encode().lower()
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line.strip(SPACE)) >= 40:
                held[key(line)].add(low(i))
    top = {k: max(v) for k, v in held.items() if len(v) >= 5}
    return [(i, t, [x for x in (t or "").split("\n") if top.get(key(x), low(i)) == low(i)]) for i, t in rows]


def test_shared_lines(spark, corpus):
    want = Counter((i, "\n".join(kept) if t is not None else None) for i, t, kept in plain_lines(corpus))
    out = line_dedup.drop_shared_lines(frame(spark, corpus))
    assert out.columns == frame(spark, []).columns
    assert by_row(out, "doc_id", "text") == want
    assert sum(len((t or "").split("\n")) - len(k) for i, t, k in plain_lines(corpus)) > 20
    assert line_dedup.drop_shared_lines(frame(spark, [])).count() == 0


def test_lines_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        line = "the same long line that very many documents have in them"
        rows = [(i, f"{line}\n{'x' * (i % 50)} own line of document number {i} and no other") for i in range(300)]
        got = by_row(line_dedup.drop_shared_lines(frame(spark, rows).repartition(7)), "doc_id", "text")
        assert got == Counter((i, "\n".join(k)) for i, _, k in plain_lines(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(spark, corpus):
    sets = [(i, shingles(t)) for i, t in corpus]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(ids):
        for j, u in ids[:a]:
            if 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    want = Counter()
    for i, s in sets:
        same = [j for j, u in ids if u == s]
        want[i, len(s), find(i) if i is not None else (find(min(same)) if s and same else None)] += 1
    assert by_row(ngram_join.jaccard_components(frame(spark, corpus)), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_tree_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 62, 60, dtype=np.uint64) for _ in range(12)]
    sets = []
    for k in range(150):
        s = base[k % 12].copy()
        s[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 1 << 62, dtype=np.uint64)
        sets.append(np.unique(s))

    def groups(links):
        p = list(range(len(sets)))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in links:
            p[find(a)] = find(b)
        return {frozenset(i for i in range(len(sets)) if find(i) == r) for r in {find(i) for i in range(len(sets))}}

    every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    sketches = [Sketch(i, len(s), width_of(len(s)), int.from_bytes(bitmap(s), "little")) for i, s in enumerate(sets)]
    real = set(every)
    linked = lambda pairs: [(a, b) for a, b, _ in pairs if (max(a, b), min(a, b)) in real]
    found = possible_links(sketches, margin=None)
    assert real <= {(max(a, b), min(a, b)) for a, b, _ in found}
    found = possible_links(sketches)
    assert all((max(a, b), min(a, b)) in real for a, b, sure in found if sure) and groups(linked(found)) == groups(every)
    assert len(found) < len(real) / 4
    # two blocks see the same links together, and what is known to be connected is left out
    halves = [sketches[::2], sketches[1::2]]
    parts = [possible_links(h) for h in halves] + [possible_links(*halves)]
    assert groups([x for p in parts for x in linked(p)]) == groups(every)
    assert not linked(possible_links(sketches, connected={i: min(g) for g in groups(every) for i in g}))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = int(rng.integers(1, 90)), int(rng.integers(1, 90))
        pool = rng.integers(0, 1 << 62, 100, dtype=np.uint64)
        x, y = np.unique(rng.choice(pool, a)), np.unique(rng.choice(pool, b))
        s, t = (Sketch(0, len(k), width_of(len(k)), int.from_bytes(bitmap(k), "little")) for k in (x, y))
        if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)):
            assert possible_links([s, Sketch(1, t.size, t.width, t.bits)], margin=None)


def test_large_groups_are_split(spark, corpus, monkeypatch):
    rows = [*corpus, *((400 + i, corpus[0][1].replace("ab", f"ab{i} ", 1)) for i in range(12)), *((500 + i, corpus[4][1] + f" tail{i} x{i % 3}") for i in range(12))]
    want = by_row(ngram_join.jaccard_components(frame(spark, rows)), "doc_id", "component_id")
    for size in (60, 700):
        monkeypatch.setattr(ngram_join, "TREE_SHINGLES", size)
        assert by_row(ngram_join.jaccard_components(frame(spark, rows)), "doc_id", "component_id") == want
    monkeypatch.setattr(ngram_join, "MARGIN", -0.6)  # trusted pairs that are none
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", 1 << 24)
    assert by_row(ngram_join.jaccard_components(frame(spark, rows), few=None), "doc_id", "component_id") == want


def test_groups_that_fit_one_tree_are_placed_without_joins(spark, monkeypatch):
    rows = [(t, node, 40 + node % 30, node % 4) for t in (1, 2, 3) for node in range(10 * t)]
    members = spark.createDataFrame(rows, "t long, node long, n long, component long")
    for full in (False, True):
        placed = ngram_join._places(members, full)
        assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, placed.collect())) == sorted((t, 0, 0, 0, node, 0) for t, node, *_ in rows)
    most = sum(n for t, _, n, _ in rows if t == 2)
    monkeypatch.setattr(ngram_join, "TREE_SHINGLES", most)  # the third group alone is split
    for full in (False, True):
        placed = [tuple(r) for r in ngram_join._places(members, full).collect()]
        assert sorted(r for r in placed if r[0] < 3) == sorted((t, 0, 0, 0, node, 0) for t, node, *_ in rows if t < 3)
        assert {r[4] for r in placed if r[0] == 3} == set(range(30)) and all(r[1] > 0 for r in placed if r[0] == 3)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {400: 400, 500: 400}


def test_suffix_array_and_kasai():
    rng = random.Random(8)
    b = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), dtype=np.uint8)
    order = suffix_dedup.suffix_array(b).tolist()
    padded = b.tobytes() + bytes(600)
    assert order == sorted(range(400), key=lambda i: padded[i : i + 512])
    before = np.full(400, -1)
    before[order[1:]] = order[:-1]
    got = suffix_dedup.kasai(suffix_dedup.words(b), before, np.arange(400), 1024)

    def common(i, j):
        n = 0
        while i + n < 400 and j + n < 400 and b[i + n] == b[j + n]:
            n += 1
        return n

    assert all(g >= common(i, j) and min(g, 400 - i, 400 - j) == common(i, j) for i, (g, j) in enumerate(zip(got, before)) if j >= 0)


def test_repeats_removed(spark):
    rng = random.Random(6)
    passage, long_one = prose(rng, 110), prose(rng, 500)
    rows = [(i, prose(rng, 60) + " " + passage[rng.randrange(40) :] + " " + prose(rng, 30)) for i in range(12)]
    rows += [(50, long_one), (51, long_one), (52, "é" + long_one[:700]), (53, passage[:399]), (54, prose(rng, 80) + passage + passage), (None, "short"), (60, None), (61, ""), (50, long_one), (70, "ab" * 400)]
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + 400] for _, t in texts for s in range(len(t) - 399))
    want = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s : s + 400] = b"\x01" * 400
        kept = bytes(c for c, d in zip(t, gone) if not d)
        want[i, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    out = suffix_dedup.repeats_removed(frame(spark, rows))
    assert by_row(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(k[2] * n for k, n in want.items()) > 8000
    assert suffix_dedup.repeats_removed(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [32, 40, 64, 128, 250, 700, 1500])
def test_repeats_of_any_length(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "SALT", 4000)
    rng = random.Random(length)
    plain = lambda n: prose(rng, n).replace("É", "e")
    shared = plain(3 * length // 5)
    rows = [(i, plain(40) + shared[rng.randrange(length) :][: rng.randrange(length // 2, 3 * length)] + plain(60)) for i in range(24)]
    rows += [(30, "ab" * length), (31, shared), (32, shared[: length - 1]), (33, None)]
    seen = Counter(t[s : s + length].encode() for _, t in rows if t for s in range(len(t) - length + 1))
    want = {}
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        want[i] = (sum(gone), hashlib.sha256(bytes(c for c, d in zip(t, gone) if not d)).hexdigest())
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.repeats_removed(frame(spark, rows), length).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 5 * length


def test_repeat_lengths_that_are_not_offered(spark):
    with pytest.raises(ValueError):
        suffix_dedup.repeats_removed(frame(spark, []), 31)


def test_anchors_of_texts_in_parts():
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (400, 0, 90, 700)]
    places = lambda found: sorted((t, f + k, h) for t, f, n, h in zip(*(x.tolist() for x in found)) for k in range(n))
    whole = places(suffix_dedup.anchors(texts, 200))
    assert whole == places(suffix_dedup.anchors(texts, 200, part=333)) and len(whole) == sum(max(len(t) - 199, 0) for t in texts)


def test_shards_merge_by_binary_search():
    rng = random.Random(3)
    base = [bytes(rng.choice(b"abcd ") for _ in range(900)) for _ in range(4)]
    pieces = {}
    for _ in range(60):
        o = rng.randrange(300)
        p = bytearray(rng.choice(base)[o : o + rng.randrange(430, 600)])
        if rng.random() < 0.7:
            p[rng.randrange(len(p))] = ord("x")
        pieces[bytes(p)] = len(p) - 399
    pieces = list(pieces.items())
    assert suffix_dedup.repeated_runs(pieces, 400) == suffix_dedup.repeated_runs(pieces, 400, shard=3000)


@pytest.mark.parametrize("salt", [1 << 20, 5000])
def test_pieces_of_a_hot_anchor_are_dealt_to_several_tasks(spark, monkeypatch, salt):
    monkeypatch.setattr(suffix_dedup, "SALT", salt, raising=False)
    rng, real = random.Random(8), suffix_dedup._shard_rows
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared, near = word(900), [word(60) for _ in range(6)]
    # most contexts are their own, some are those of a few other documents
    rows = [(i, word(rng.randrange(50, 300)) + (rng.choice(near) if i % 3 == 0 else "") + shared + (rng.choice(near) if i % 4 == 0 else "") + word(rng.randrange(50, 300))) for i in range(300)]

    def counted(length):
        run = real(length)

        def check(batches):
            batches = list(batches)
            most = Counter(x for b in batches for x in b.column("h").to_pylist()).most_common(1)
            assert salt > 5000 or not most or most[0][1] < 200, "most pieces of one anchor are in one task"
            yield from run(iter(batches))

        return check

    monkeypatch.setattr(suffix_dedup, "_shard_rows", counted)
    count = Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    want = {}
    for i, t in rows:
        gone = set()
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone.update(range(k, k + 400))
        want[i] = (len(gone), hashlib.sha256("".join(c for k, c in enumerate(t) if k not in gone).encode()).hexdigest())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few bytes would go to one task again
    try:
        out = suffix_dedup.repeats_removed(frame(spark, rows), keep_bytes=False).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in out} == want


def test_containment(spark, corpus):
    items = [(1, " ".join(corpus[0][1].split()[:20])), (2, "not in any document of them all"), (3, None), (4, "one two"), (None, " ".join(corpus[5][1].split()[3:30]))]
    docs = [*corpus, (400, "Intro words. " + items[0][1].upper() + " and more"), (401, " ".join((items[0][1].split() * 2)[6:20]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    sets = defaultdict(set)
    for i, t in docs:
        sets[i] |= shingles(t)
    want = {(d, i, len(shingles(t)), len(shingles(t) & s)) for d, s in sets.items() for i, t in items if shingles(t) and 4 * len(shingles(t) & s) >= 3 * len(shingles(t))}
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert got == want and {d for d, *_ in want} >= {0, 400}
    clean = decontamination.without_benchmark(frame(spark, docs), bench)
    assert by_row(clean, "doc_id") == Counter((i,) for i, _ in docs if i not in {d for d, *_ in want})
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0


def test_licences(spark):
    rows = [
        (1, "Released under the MIT License. mit-license MIT, license x"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "mit einer lizenz; license mit general public"),
        (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0."), (2, "ÉMIT LICENSE mit license"),
        (7, "word " * 3000 + "general\npublic\tlicense"),
    ]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        want[i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))] += 1
    out = license_scan.scan_licences(frame(spark, rows))
    assert by_row(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    labels = {(r.doc_id, r.n_words): (r.labels, r.score) for r in out.collect()}
    assert labels[3, 12][0] == "gpl,gpl-3.0" and labels[2, 8][0] == "apache,apache-2.0" and labels[None, 7][0] == "cc-by-nc-4.0" and labels[4, 7][0] == ""
    assert all(0 <= s <= 1 and (s > 0) == bool(x) for x, s in labels.values())
    assert license_scan.scan_licences(frame(spark, [])).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["It's ABC's 's x'll don't 12ab34--..'re", "a<|endoftext|>b", "Éèê ÀÈ ²x½ ª ß", "ﬁ Σας Οδυσσεύς", "a\x1cb\x85c", "_a_b\x00", "日本語 text", "école"]


def test_fast_ids_of_every_plain_character():
    from arealis.llm import tokens

    plain = [c for c in map(chr, range(0x250)) if not tokens._PLAIN.search(c)]
    texts = [t for c in plain for t in (c, f"a{c}b {c}1{c}", f"x {c}{c.lower()}'s")] + ["Ən yaxşı", "Ɗan Adam", "Ɓera"]
    got = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(texts)
    want = library_ids(texts)
    assert [t for t, g, w in zip(texts, got, want) if np.frombuffer(g, dtype="<u4").tolist() != w] == []


def test_token_files_round_trip(spark, corpus, tmp_path):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)]
    token_files.write_token_files(frame(spark, rows), f"file://{tmp_path}/t")
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    order = sorted(zip(rows, library_ids([t for _, t in rows])), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, (x[0][1] or "").encode()))
    at = 0
    for r, ((i, _), ids) in zip(got, order):
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids) + 1)
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == [*ids, 2]
        at += len(ids) + 1
    assert len(got) == len(rows)
    token_files.write_token_files(frame(spark, []), f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_code_lengths_are_limited_and_complete():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = token_files.code_lengths(np.array(fib), limit=12)
    assert lengths.max() == 12 and sum(2.0 ** -int(x) for x in lengths) == 1.0
    assert token_files.code_lengths(np.zeros(3, dtype=int)).tolist() == [0, 0, 0]


def test_packing(spark, corpus):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)]
    out = packing.best_fit_sequences(packing.token_pieces(frame(spark, rows), room=256), room=256).collect()
    want = Counter()
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        ids = [*ids, 1]
        for k in range(0, len(ids), 256):
            p = ids[k : k + 256]
            want[i, k // 256, k, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in out]), 256) + 1
    assert packing.best_fit_sequences(packing.token_pieces(frame(spark, []))).count() == 0


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 50)
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.randrange(1, 2000), i) for i in range(1500)]
    out = packing.best_fit_sequences(spark.createDataFrame(rows, "doc_id long, piece long, start long, length long, ids_crc32 long")).collect()
    assert sorted(r.doc_id for r in out) == list(range(1500))
    assert len({r.sequence_id for r in out}) <= packing.lower_bound(np.array([r[3] for r in rows]), 4096) * 1.02 + 1


def test_no_task_packs_more_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 300)
    sizes = np.random.default_rng(4).integers(700, 1300, 3000)
    rows = [(i, 0, 0, int(x), i) for i, x in enumerate(sizes)]
    out = packing.best_fit_sequences(spark.createDataFrame(rows, "doc_id long, piece long, start long, length long, ids_crc32 long"))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = out.collect()
    bins, tasks = defaultdict(list), Counter(r.sequence_id >> 32 for r in out)  # round and partition
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.doc_id for r in out) == list(range(3000)) and max(tasks.values()) < 600
    for b in map(sorted, bins.values()):
        assert [o for o, _ in b] == [sum(x for _, x in b[:k]) for k in range(len(b))] and sum(x for _, x in b) <= 4096
    assert len(bins) <= packing.best_fit(sizes, 4096).max() + 1 + 10


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        assert packing.lower_bound(sizes, 100) <= packing.best_fit(sizes, 100).max() + 1
    assert packing.lower_bound(np.full(10, 51), 100) == 10 and packing.lower_bound(np.array([], dtype=int), 100) == 0


def classifier_rows(rng, bad):
    rows, labels = [], []
    for i in range(400):
        y = i % 2
        rows.append((i, bad(prose(rng, 40)) if not y else prose(rng, 40)))
        labels.append((i, y, 1 - y))
    return rows, labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    rng = random.Random(9)
    rows, labels = classifier_rows(rng, lambda t: t.replace(" ", "%%% ", 12) + " scum idiot trash fool scum2 idiot")
    labels += [(None, 1, 1), (5000, None, None)]
    rows += [(900, None), (901, ""), (None, "plain"), (7, rows[7][1])]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    f, positive = (quality.quality, 1) if kind == "quality" else (toxicity.toxicity, 0)
    out = f(frame(spark, rows), lab).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert all(r.held_out == crc_held_out(r.doc_id) for r in out) and held
    assert sum(r.predicted == (positive if r.doc_id % 2 else 1 - positive) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert f(frame(spark, rows), lab.limit(0)).count() == len(rows) and f(frame(spark, []), lab).count() == 0


def test_kneser_ney_against_plain_counts():
    rng = random.Random(2)
    vocabulary = [a + b for a in ("loud", "quiet", "ab", "meanest") for b in ("", "er", "est", "ly", "xx")]
    texts = [[rng.choice(vocabulary[: 20 if i % 2 else 13]) for _ in range(30)] for i in range(40)]
    labels = np.array([i % 2 for i in range(40)])
    m = toxicity.KneserNey.fit(*(lambda ids, names: (ids, labels, names))(*toxicity.numbered(map(" ".join, texts))), 2.0, 2.0)
    known = sorted({w for t in texts for w in t})
    pairs = {p for t in texts for p in zip(t, t[1:])}
    shared = {w: 1 + sum(b == w for _, b in pairs) for w in known}
    for c in (0, 1):
        mine = [t for t, y in zip(texts, labels) if y == c]
        both = [[t for t, y in zip(texts, labels) if y == k] for k in (0, 1)]

        def level(cut, lower):
            items = {cut(w) for w in known}
            count = [{x: sum(len({w for w in set(t) if cut(w) == x}) for t in docs) for x in items} for docs in both]
            kept = [{x: max(n - 2, 0) for x, n in k.items()} for k in count]
            spare = 1 - sum(sum(kept[k].values()) / sum(count[k].values()) for k in (0, 1)) / 2
            return {x: (1 - spare) * kept[c][x] / sum(kept[c].values()) + spare * lower(x) for x in items}

        mass = lambda n, x: sum(s for w, s in shared.items() if w[:n] == x)
        p4 = level(lambda w: w[:4], lambda x: mass(4, x) / (sum(shared.values()) + 1))
        p6 = level(lambda w: w[:6], lambda x: p4[x[:4]] * mass(6, x) / (mass(4, x[:4]) + 1))
        word = level(lambda w: w, lambda x: p6[x[:6]] * shared[x] / (mass(6, x[:6]) + 1))
        assert sum(word.values()) < 1
        for v in known:
            n = [Counter(b for t in docs for a, b in set(zip(t, t[1:])) if a == v) for docs in both]
            left = [{w: max(k - 2, 0) for w, k in x.items()} for x in n]
            if all(sum(x.values()) for x in left):
                spare = 1 - sum(sum(left[k].values()) / sum(n[k].values()) for k in (0, 1)) / 2
                want = {w: (1 - spare) * left[c].get(w, 0) / sum(left[c].values()) + spare * word[w] for w in known}
            else:
                want = word
            got = {w: m.probabilities([v, w])[c, 1] for w in known}
            assert all(abs(got[w] - want[w]) < 1e-12 for w in known)
            # what is missing to one is what unknown words of each beginning get
            rest = 1 - sum(word.values())
            assert abs(1 - sum(want.values()) - rest * (spare if want is not word else 1)) < 1e-12
        assert mine
    assert m.features([]) == (0.0,) * (1 + len(toxicity.PASSAGES)) and abs(m.features(["unheard"])[0]) < 1e-12
    assert m.features(["meanestzz"])[0] > 0  # an unknown form of a beginning that is more toxic


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """Models counted by Spark, whole and without a fold, against those of the same texts in memory."""
    monkeypatch.setattr(word_counts, "HELD_KEYS", 3000)
    rng = random.Random(4)
    vocabulary = [a + b for a in ("loud", "quiet", "ab", "meanest", "\u00e9t\u00e9s") for b in ("", "er", "est", "ly", "xx")]
    rows = [(i, " ".join(rng.choice(vocabulary[: 25 if i % 3 else 18]) for _ in range(rng.randrange(1, 60)))) for i in range(700)]
    labels = [(i, int(i % 3 > 0)) for i, _ in rows] + [(3, None), (9001, 1)]
    rows += [(900, "loud " * 50_000 + "never"), (901, None), (902, rows[7][1] + " quiet"), (5, "a"), (None, "loud")]
    labels += [(900, 1), (901, 0), (902, 1), (None, 1)]
    texts, share = toxicity.labelled_rows(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic")
    known = {i: y for i, y in labels if i is not None and y is not None and not crc_held_out(i)}
    plain = {}
    for i, t in rows:
        if i in known:
            plain[i] = min(plain.get(i, t or ""), t or "")
    assert {r.doc_id: (r.label, r.text) for r in texts.collect()} == {i: (known[i], t) for i, t in plain.items()}
    assert abs(share - sum(known.values()) / len(known)) < 1e-12
    kept = word_counts.one_of_near_copies(texts).collect()
    seen, want = set(), []
    for i, t in sorted(plain.items()):
        marks = set(word_counts.bands(np.array([zlib.crc32(w.encode()) for w in toxicity.words(t)], dtype=np.int64)))
        want += [i] if not marks & seen else []
        seen |= marks
    assert sorted(r.doc_id for r in kept) == want and len(want) > 400
    counts = word_counts.word_counts(spark.createDataFrame(kept, "doc_id long, label int, fold int, text string").repartition(3), 8.0)
    found = word_counts.model_counts(counts, toxicity.STEMS, 3.0)
    for m in range(word_counts.FOLDS + 1):
        mine = [r for r in kept if r.fold != m]
        ids, names = toxicity.numbered(r.text for r in mine)
        a = toxicity.KneserNey.fit(ids, np.array([r.label for r in mine]), names)
        b = toxicity.KneserNey.of_tables(word_counts.model_tables(found, m, 3.0))
        assert set(b.index) <= set(a.index) and len(b.pairs)
        for text in [*(r.text for r in kept[:40]), "unheard of loudest meanestzz \u00e9t\u00e9szz", ""]:
            assert np.allclose(a.features(toxicity.words(text)), b.features(toxicity.words(text)), atol=1e-12)
            w = [x for x in toxicity.words(text) if x in b.index]
            assert np.allclose(a.probabilities(w), b.probabilities(w), rtol=1e-12)


def test_logistic_fit_by_sums_over_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=500) > 0.7).astype(int)
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "label int, x array<double>")
    w, ones = toxicity.fit_logistic_rows(rows.repartition(5), 3)
    assert np.allclose(w, toxicity.fit_logistic(x, y), atol=1e-9) and ones == y.mean()
    for some in (rows.where("label = 1"), rows.limit(0)):
        n = some.count()
        assert np.allclose(toxicity.fit_logistic_rows(some, 3)[0], toxicity.fit_logistic(np.zeros((n, 3)), np.ones(n)))


def test_toxicity_scores_against_sums_over_words():
    """The final score by plain loops: models, whole text, passages, weights."""
    rng = random.Random(12)
    rows, labels = classifier_rows(rng, lambda t: t + " scum idiot trash")
    import pandas as pd

    sample = pd.DataFrame([(t, {i: x for i, _, x in labels}[i]) for i, t in rows if i is not None and i in {x[0] for x in labels}], columns=["text", "label"])
    model = toxicity.train(sample, 0.3)
    texts = ["", "unheard of", *sample["text"][:30], "scum " * 5 + rows[0][1], " ".join(rows[k][1] for k in range(40)) * 30]
    for text, got in zip(texts, toxicity.score_texts(model, texts)):
        w = re.findall(r"[^\W_]+", text.lower())
        ratio = [math.log(model.probabilities(w[max(k - 1, 0) : k + 1])[1, -1] / model.probabilities(w[max(k - 1, 0) : k + 1])[0, -1]) for k in range(len(w))] if len(w) < 3000 else None
        if ratio is None:
            p = model.probabilities(w)
            ratio = (np.log(p[1]) - np.log(p[0])).tolist()
        x = [sum(ratio) / len(w) if w else 0.0]
        for n in toxicity.PASSAGES:
            starts = range(0, max(len(w) - n // 2, 1), max(n // 2, 1))
            x.append(max(sum(ratio[s : s + n]) / n for s in starts) if w else 0.0)
        z = sum(a * b for a, b in zip([*x, 1.0], model.weights))
        assert abs(got - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-9


def test_texts_are_scored_and_banded_together_as_one_by_one():
    rng = random.Random(12)
    rows, labels = classifier_rows(rng, lambda t: t + " scum idiot trash")
    import pandas as pd

    known = {i: x for i, _, x in labels}
    model = toxicity.train(pd.DataFrame([(t, known[i]) for i, t in rows if known.get(i) is not None], columns=["text", "label"]), 0.3)
    odd = ["", "  ", "a", "scum_idiot\u00a0TRASH\u2028fool", "\u039f\u0394\u039f\u03a3 \u0130stanbul stra\u00dfe", "x" * 70 + "-" + "y" * 70, "unheard of scumbags", "-- __ ..", "scum\x1cidiot\x85trash"]
    texts = [*odd, *(t or "" for _, t in rows[:60]), *odd[::-1], " ".join(t or "" for _, t in rows)]
    assert [toxicity.words(t) for t in texts] == [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    numbers = [np.array([zlib.crc32(w.encode()) for w in toxicity.words(t)], dtype=np.int64) for t in texts]
    assert word_counts.bands_of(numbers) == [word_counts.bands(t) for t in numbers]
    alone = np.array([model.features(toxicity.words(t)) for t in texts])
    assert (model.features_of(texts) == alone).all()
    assert [w for some in word_counts.some_at_once(texts, 40) for w in some] == [toxicity.words(t) for t in texts]


def test_cross_validation_prefers_a_discount_that_helps():
    rng = random.Random(12)
    rows, labels = classifier_rows(rng, lambda t: t + " scum idiot trash")
    import pandas as pd

    known = {i: x for i, _, x in labels}
    sample = pd.DataFrame([(t, known[i]) for i, t in rows if known.get(i) is not None], columns=["text", "label"])
    losses = [toxicity.cross_validated_loss(sample, 0.5, discount=d, pair_discount=8.0) for d in (1.0, 3.0)]
    assert all(0 < x < 0.5 for x in losses)


def test_bytes_through_the_network_by_plain_loops():
    net = quality.ByteNet.random(filters=3, width=4, seed=1)
    net.bias += np.array([0.1, -0.2, 0.05], np.float32)
    net.prior = -0.3
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 255, 259, 260, 600, 3000, 70_000):
        text = bytes(rng.randrange(256) for _ in range(n))
        b = text.ljust(4, b"\0")
        step = quality.STEP
        at = lambda s, f: sum(float(net.taps[k, b[s + k], f]) for k in range(4))
        places = len(b) - 3
        steps = [range(lo, min(lo + step, places)) for lo in range(0, places, step)]
        best = [[max(at(s, f) for s in r) for f in range(3)] for r in steps]
        chunks = [[max(x, y) for x, y in zip(p, q)] for p, q in zip(best, best[1:])] or best
        relu = [[max(v + float(net.bias[f]), 0.0) for f, v in enumerate(c)] for c in chunks]
        h = [sum(c[f] for c in relu) / len(relu) for f in range(3)] + [max(c[f] for c in relu) for f in range(3)]
        assert abs(net.logit(text) - (sum(x * float(o) for x, o in zip(h, net.out)) + net.prior)) < 1e-4


def test_licence_labels_and_scores_equal_every_start_tried(spark):
    rng = random.Random(6)
    loose = sorted({w for t, *_ in license_scan.TEMPLATES for w in t.split()})
    rows = [(i, " ".join(rng.choice(loose) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    for i, (t, *_) in enumerate(license_scan.TEMPLATES):  # whole, with a gap, with other words, cut at either end
        w = t.split()
        rows += [(100 + i, f"Intro. {t.upper()}; end"), (200 + i, " ".join(w[: len(w) // 2] + ["x"] + w[len(w) // 2 :])), (300 + i, " ".join(rng.choice([a, a, a, "other"]) for a in w)), (400 + i, " ".join(w[1:])), (500 + i, f"{' '.join(w[:-1])} {t} {t}")]
    rows += [(None, None), (1, ""), (600, "filler " * 20_000 + license_scan.TEMPLATES[0][0])]
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    templates = [(p.split(), label, [p.split()]) for p, label in license_scan.BASE.items()] + [(t.split(), label, [k.split() for k in keys]) for t, label, keys in license_scan.TEMPLATES]
    idf = {x: math.log((len(rows) + 1) / (1 + sum(x in w for w in words))) for t, *_ in templates for x in t}
    want = []
    for (i, _), w in zip(rows, words):
        labels, best, at = set(), 0.0, dict(enumerate(w))
        for t, label, keys in templates:
            must = set(sorted(range(len(t)), key=lambda k: (-idf[t[k]], t[k], k))[:2])
            for key in keys:
                first = next(k for k in range(len(t)) if t[k : k + len(key)] == key)
                must |= set(range(first, first + len(key)))
            for s in range(-len(t), len(w)):
                if all(at.get(s + k) == t[k] for k in must):
                    labels.add(label)
                    best = max(best, sum(idf[x] for k, x in enumerate(t) if at.get(s + k) == x) / (sum(idf[x] for x in t) or 1.0))
        want.append((i, ",".join(sorted(labels)), round(min(best, 1.0), 9)))
    got = [(r.doc_id, r.labels, round(r.score, 9)) for r in license_scan.scan_licences(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(want) and len({label for _, labels, _ in want for label in labels.split(",")}) > 10
