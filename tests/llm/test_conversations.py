"""Reply trees, prefix tries and importance weights against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from arealis.llm import chat_format, conversation_trie, importance

TURNS = "conv_id long, turn long, role string, text string, node binary, h int, leaf string"


def turns_frame(spark, rows):
    """Conversations with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, b"x", 1, "y") for r in rows], TURNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    said = ["hello there", "a\n b", "", None, "<|im_end|>", "<\\|x", "<|im_start|>user\nhi", "é " * 300, "<\\\\|", "|<|"]
    rows = []
    for c in [*range(0, 45), 60, 61, -3, -20]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "sy\nst%em|", None]), rng.choice(said[:3] if t < 4 else said)))
    rows += [(100 + k, t, "user", f"turn {t}") for k in range(6) for t in range(12)]  # copies
    rows += [(120, t, "user" if t % 2 else "assistant", f"turn {t % 3}") for t in range(150)]
    rows += [(7, 0, "user", "hello there"), (7, 0, "user", "hello there"), (8, None, "user", "first"), (9, None, None, None), (140, None, "assistant", "alone")]
    return rows


def digest_of(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def rebuilt_talks(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest_of(role, text), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + mine[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not kids[k]
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(convs[c]) == len(k)))) for k, m in members.items())


def trie_rows(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def trie_of(spark, rows, size):
    turns = conversation_trie.numbered_turns(conversation_trie.turn_digests(turns_frame(spark, rows)))
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns), size=size)


@pytest.mark.parametrize("size", [1, 4])
def test_prefix_trie(spark, talks, size):
    rows = [*talks, (None, 1, "user", "of no conversation")]
    assert trie_rows(trie_of(spark, rows, size)) == plain_trie(rebuilt_talks(rows))


def test_trie_without_turns(spark):
    assert trie_of(spark, [], 4).count() == 0
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # loses its turns, and its base is not there
    rows = [(gone, 0, "user", "x"), (gone, 1, "user", "y")]
    assert trie_rows(trie_of(spark, rows, 4)) == plain_trie(rebuilt_talks(rows)) == Counter([(gone, 0, None, 1, 0, 1, 0, sha(str(gone)))])


def test_large_groups_of_ends_are_joined_in_pieces(spark):
    ids = random.Random(1).sample(range(10**6), 5000)
    rows = spark.createDataFrame([(bytes([c % 3 == 0]), c) for c in ids], "node binary, conv_id long")
    got = {bytes(r.node): r.ends_sha256 for r in conversation_trie.ends_digests(rows, chunk=7).collect()}
    assert got == {bytes([k]): sha(",".join(str(c) for c in sorted(ids) if (c % 3 == 0) == k)) for k in (False, True)}


def test_turns_are_numbered_across_ranges(spark):
    rows = [(1, t, "user", str(t)) for t in random.Random(3).sample(range(3000), 3000)] + [(c, 0, "user", "x") for c in range(2, 9)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = conversation_trie.numbered_turns(conversation_trie.turn_digests(turns_frame(spark, rows))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {digest_of("user", str(t)): t + 1 for t in range(3000)}
    assert {r.digest.hex(): r.pos for r in got if r.conv_id == 1} == want and len(got) == 3007


def test_chats_read_back(spark, talks):
    rows = [*talks, (None, 0, "user", "no id"), (None, 1, "assistant", "none either")]
    messages = chat_format.conversation_messages(turns_frame(spark, rows))
    got = {r.tree_id: r for r in chat_format.read_back(chat_format.formatted(messages, chat_format.reply_paths(messages))).collect()}
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == own.keys()
    for c, want in own.items():
        want, r = sorted(want), got[c]
        assert [(x.role, x.text) for x in r.read] == [w[2:] for w in want]
        assert [x.covered for x in r.read] == [w[3] if w[2] == "assistant" else None for w in want]
        assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>\n") == len(want)
        for span, (*_, role, text) in zip(r.turns, want):
            here = r.text[span.start : span.end]
            assert re.sub(r"<\\(\\*)\|", r"<\1|", here) == text and span.loss == (role == "assistant")
    empty = chat_format.conversation_messages(turns_frame(spark, []))
    assert chat_format.read_back(chat_format.formatted(empty, chat_format.reply_paths(empty))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(8)
    rows, parents = [], {}
    for i in range(300):
        tree = i % 4
        above = [j for j in range(i) if j % 4 == tree]
        parents[i] = rng.choice(above[-12:]) if above and rng.random() < 0.97 else None
        rows.append((tree, f"m{i}", None if parents[i] is None else f"m{parents[i]}", rng.choice(["user", "assistant"]), f"text {i}", rng.choice([0.0, 1.0, 2.5, None])))
    rows += [(9, "lost", "not there", "user", "orphan", 1.0), (9, "a", "b", "user", "circle", 1.0), (9, "b", "a", "user", "circle", 1.0), (9, "c", "b", "user", "below it", 1.0), (9, None, "m1", "user", "no id", 1.0), (None, "n", None, "user", "no tree", None)]
    rows += [rows[-1], rows[5]]
    df = spark.createDataFrame(rows, "tree_id long, message_id string, parent_id string, role string, text string, score double").selectExpr("*", "1 as leaf", "2 as position")
    by_id = {r[1]: r for r in rows}
    up = {f"m{i}": None if p is None else f"m{p}" for i, p in parents.items()} | {"lost": None, "n": None}
    inner = {p for p in up.values() if p}
    want = defaultdict(list)
    for leaf in up.keys() - inner:
        way = [leaf]
        while up[way[-1]]:
            way.append(up[way[-1]])
        want[by_id[leaf][0]].append((-sum(by_id[m][5] or 0 for m in way) / len(way), leaf, way[::-1]))
    for best in (1, 3, None):
        got = defaultdict(list)
        chats = chat_format.format_trees(df, best).collect()
        for r in chats:
            got[r.tree_id].append((r.branch_rank, r.leaf, re.findall(r"text \d+|orphan|no tree", r.text)))
        for tree, ways in want.items():
            ways = sorted((round(s, 9), leaf, way) for s, leaf, way in ways)
            chosen = [(k + 1 if best else None, leaf, [by_id[m][4] for m in way]) for k, (_, leaf, way) in enumerate(ways[:best])]
            assert sorted(got[tree], key=str) == sorted(chosen, key=str)
        assert got.keys() == want.keys()


DOCS = "doc_id long, text string, sha string, copies int, line string"


def plain_counts(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 50 for k in range(1, n + 1) for i in range(len(w) - k + 1)]))
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_importance(spark, n):
    rng = random.Random(n)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "gamma9", "x"]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 7)))
    shared = [line() for _ in range(4)]
    rows = [(i, "\n".join(rng.choice([line(), rng.choice(shared), ""]) for _ in range(rng.randrange(1, 12)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, rows[5][1]), (None, None), rows[3], rows[3], (3, "alpha\nbeta " * 15), (203, "word " * 30_000), (204, "a\nb\n" * 3000)]
    target = [(1, "beta gamma9\nbeta"), (2, None), (3, "été été x")]
    got = importance.resampled(spark.createDataFrame([(*r, "s", 7, "l") for r in rows], DOCS), spark.createDataFrame(target, "item_id long, text string"), n=n, size=50, min_words=8, percent=30)
    docs, wanted = plain_counts([t for _, t in rows], n), plain_counts([t for _, t in target], n)
    s, t = Counter(b for _, f in docs for b in f), Counter(b for _, f in wanted for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)}
    want = []
    for (i, text), (n_words, f) in zip(rows, docs):
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words, hashlib.sha256((text or "").encode()).digest()])
    fit = sorted((w for w in want if w[4] >= 8), key=lambda w: (-w[3], w[0] is not None, w[0] or 0, w[5]))
    drawn = len(fit) * 30 // 100
    ranks = Counter((*w[:4], k + 1 if k < drawn else None) for k, w in enumerate(fit)) + Counter((*w[:4], None) for w in want if w[4] < 8)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == ranks
    none = spark.createDataFrame([], DOCS)
    assert importance.resampled(none, spark.createDataFrame(target, "item_id long, text string"), n=n).count() == 0
    flat = importance.resampled(spark.createDataFrame([(*r, "s", 7, "l") for r in rows[:9]], DOCS), none.selectExpr("doc_id as item_id", "text"), n=n, size=50)
    assert flat.count() == 9
