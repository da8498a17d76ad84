"""Operators against brute force, the tokenizers library, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelight.llm import bpe, context_tree, exact_dedup, html_text, jaccard_join, packing, pii, quality, toxicity, vector_join
from quirelight.llm.common import components, word_hashes
from quirelight.llm.tokens import load, word_token_ids

TOKENIZERS = os.environ.get("QUIRELIGHT_TOKENIZERS", "/opt/tokenizers")
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def near_texts(n=60, seed=0):
    """Texts with exact copies, near copies of several degrees and a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    passage, out = [word() for _ in range(30)], []
    for _ in range(n):
        base = [word() for _ in range(r.randint(1, 120))]
        if r.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return list(enumerate(out))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_bpe_equals_the_library():
    own, lib = bpe.vocabulary(f"{TOKENIZERS}/byte_bpe_50k.json"), load(f"{TOKENIZERS}/byte_bpe_50k.json")
    r = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", " \n", "'s", "é", "日本", "12", "!", "\x1c", "\u0085", "　", "<|endoftext|>", "<|endo", "́", "😀", " the", "​", "Hello,", "\ua7dd", "\U00018e6b", "'ll"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)] + ["x" * 700 + "ab" * 300]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids and own.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_word_ids_equal_the_library():
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    encode, lib, r = word_token_ids(path), load(path), random.Random(2)
    parts = ["A", "É", "ª", "²", "½", "İ", "µ", " ", "\n", "'LL", "日本", "12", "!?", "\x1c", "　", "<|endoftext|>", "́", "😀", "word", "Σ"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@needs_data
def test_bpe_round_trip(spark):
    docs, path = table(spark, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json"
    back = bpe.decode_ids(bpe.encode_ids(docs, path), path)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0
    row = bpe.encode_decode(docs, path).orderBy("doc_id").first()
    text = docs.filter(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@needs_data
def test_packing_holds_every_id_once_without_padding(spark):
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    docs, lib = table(spark, "documents"), load(path)
    got = packing.pack(docs, path).collect()
    ids = {r["doc_id"]: [*lib.encode(r["text"], add_special_tokens=False).ids, 2] for r in docs.collect()}
    at, sequences = defaultdict(int), defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(at) == {k: len(v) for k, v in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096 and end & (end - 1) == 0


def test_pii_equals_plain_matching(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, v):
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        d = [int(c) for c in v if c.isdigit()]
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    r = random.Random(5)
    parts = [*"ab1234567890..@@+ --() éA%", "user@x.org ", "1.2.3.4", "+1 (988) 555-2485", "4041894974608795", "4532 0151 1283 0366", "😀", "255.255.0255.1", "\n"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(1500)] + [None, "a@b.com_d@e.f.g", "1.2.3.4.5.6.7.8", "1" * 40]
    got = {x["doc_id"]: x for x in pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if fine(kind, m[0]))
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("term")] == [s for s in base.split(",") if s]


def test_pii_terms_that_give_an_entity_away_are_removed(spark):
    rows = [(i, f"alpha{i} beta{i} zorblat the contact{i} bob@corp.example.com by gamma{i} delta{i}") for i in range(6)]
    rows += [(100 + i, f"the plain text {i} by nobody") for i in range(200)]
    rows += [(1000 + i, "the same zorkon joe@corp.example.com by copy") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zorblat" not in got[0] and "[EMAIL]" in got[0] and "the" in got[0] and "alpha0" in got[0]
    assert got[100] == "the plain text 0 by nobody" and "zorkon" in got[1000]


def corpus(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"the plain text {i} by nobody") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pii_terms_are_counted_and_removed_in_the_whole_document(spark):
    gap = lambda i: " ".join(f"gap{i}x{k}" for k in range(9))
    texts = [f"Zorblat! {gap(i)} bob@corp.example.com {gap(i + 50)} (zorblat) the far end{i}" for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(corpus(spark, texts)).collect()}
    for i in range(6):
        assert got[i] == f"! {gap(i)} [EMAIL] {gap(i + 50)} () the  end{i}"
    assert got[1000] == "the plain text 0 by nobody"


def test_pii_terms_equal_brute_force(spark):
    r = random.Random(9)
    mails = [f"m{k}@x{k}.org" for k in range(5)]
    texts = []
    for _ in range(80):
        words = [f"w{r.randrange(60)}" for _ in range(r.randint(1, 25))]
        for k in r.sample(range(5), r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = r.choice(["<{}>", "{},", "n:{}"]).format(mails[k])
            words.insert(r.randrange(len(words)), r.choice([f"Name{k}", f"“name{k}”,", f"other{k}"]))
        texts += [" ".join(words)] * r.choice([1, 1, 1, 3])
    held = [set(re.findall(r"m\d@x\d\.org", t)) for t in texts]
    said = [{w for x in re.sub(r"m\d@x\d\.org", " ", t).lower().split() if len(w := x.strip("<>,:“”")) > 1} for t in texts]
    n, df, of = len(texts) + 200, Counter(w for s in said for w in s), Counter(e for s in held for e in s)
    df.update({w: 200 for w in ("the", "plain", "text", "by", "nobody")})
    both, support = Counter(), defaultdict(set)
    for t, s, h in zip(texts, said, held, strict=True):
        for p in ((w, e) for w in s for e in h):
            both[p] += 1
            support[p].add(t)
    tells = {(w, e) for (w, e), k in both.items() if len(support[w, e]) >= pii.SUPPORT and math.log2(k * n / (df[w] * of[e])) >= pii.DISCLOSURE * math.log2(n / of[e])}
    assert len(tells) > 5
    got = {x["doc_id"]: x["spans"] for x in pii.pii(corpus(spark, texts)).collect()}
    for i, t in enumerate(texts):
        plain = re.sub(r"m\d@x\d\.org", lambda m: " " * len(m[0]), t)
        terms = {w for w, e in tells if e in held[i]}
        expected = [(m.start(), m.end()) for m in re.finditer(r"[^\s<>,:“”]+", plain) if m[0].lower() in terms]
        assert [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("term")] == expected


def test_pii_long_words_beside_a_span_cut_nothing_off(spark):
    token = "https://" + "k9" * 150
    texts = [f"a{i} b{i} Zorblat {token} joe@x.org c{i} d{i}" for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(corpus(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == [f"a{i} b{i}   [EMAIL] c{i} d{i}" for i in range(6)]


def test_pii_support_is_of_texts_not_of_contexts(spark):
    line = "Regards Jane Doe from the text jane@corp.com by the plain text"
    texts = [f"u{i} v{i} {line}" for i in range(6)] + [f"y{i} Zorkon rare{i} joe@x.org" for i in range(2)] + ["one Quux ann@y.org"] * 3
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(corpus(spark, texts)).collect()}
    assert got[0] == "u0 v0     the text [EMAIL] by the plain text"
    assert got[6] == "y0  rare0 [EMAIL]" and got[8] == "one Quux [EMAIL]"


def test_golomb_codes_come_back():
    r = np.random.default_rng(0)
    for n, width in ((0, 20), (1, 20), (500, 40), (3000, 12)):
        v = np.sort(r.integers(0, 1 << width, n, dtype=np.uint64))
        k, unary, rest = exact_dedup.golomb_encode(v, width)
        assert (exact_dedup.golomb_decode(n, k, unary, rest) == v).all()


def brute_groups(docs):
    """{id: (size of the set, smallest id reachable)} by comparing every pair of different sets."""
    sets = {i: shingles(t) for i, t in docs}
    kinds = {}
    for i, s in sets.items():
        kinds.setdefault(s, []).append(i)
    index = {t: k for k, t in enumerate({t for s in kinds for t in s})}
    groups = [v for s, v in kinds.items() if s]
    codes = [np.array(sorted(index[t] for t in s)) for s in kinds if s]
    sizes = np.array([len(c) for c in codes])
    links = [(a, v[0]) for v in groups for a in v]
    holders = {}
    for k, c in enumerate(codes):
        both = np.zeros(k, np.int64)
        for t in c.tolist():
            at = holders.setdefault(t, [])
            both[at] += 1
            at.append(k)
        links += [(groups[k][0], groups[j][0]) for j in np.flatnonzero(100 * both >= 80 * (sizes[:k] + sizes[k] - both))]
    expected = grouped(sets, links)
    return {i: (len(s), expected[i]) for i, s in sets.items()}


def joined(spark, docs):
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def large_group(n=900, seed=11):
    """Copies of one text with so many changes that most are near neither its centre nor each other, but chains of them are; and passages."""
    r = random.Random(seed)
    word = lambda k=9: "w" + str(r.randrange(k))
    base = [word(10**6) for _ in range(110)]
    passage = [word(10**6) for _ in range(40)]
    out = [list(base)]
    for _ in range(n):
        copy = list(r.choice(out) if r.random() < 0.4 else base)
        for _ in range(r.choice([1, 2, 3, 3, 4])):
            copy[r.randrange(len(copy))] = word(r.choice([3, 10**6]))
        out.append(copy)
    out += [passage + [word(10**6) for _ in range(r.randint(0, 30))] for _ in range(300)]
    out += [[word(4) for _ in range(r.randint(0, 12))] for _ in range(200)]
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_jaccard_join_equals_brute_force(spark):
    docs = near_texts()
    assert joined(spark, docs) == brute_groups(docs)


@pytest.mark.parametrize("hot", [4, 1024])
def test_jaccard_join_of_a_large_group_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT_LIST", hot)
    monkeypatch.setattr(jaccard_join, "FEW", 64 if hot == 4 else 16)
    monkeypatch.setattr(jaccard_join, "CENTRE_ROWS", 50)
    docs = large_group(seed=hot)
    expected = brute_groups(docs)
    assert len({c for _, c in expected.values()}) > 300
    assert joined(spark, docs) == expected


@needs_data
def test_jaccard_join_of_the_test_table_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").select("doc_id", "text").collect()]
    assert joined(spark, docs) == brute_groups(docs)


@pytest.mark.xfail(reason="known failure: on groups whose copies are mostly not near each other, pairs grow by more than 8 for 4 times the copies")
def test_jaccard_join_makes_pairs_in_proportion_to_a_group(spark, monkeypatch):
    made = []
    compared = jaccard_join.compared
    monkeypatch.setattr(jaccard_join, "compared", lambda pairs, *more: (made.append(pairs.count()), compared(pairs, *more))[1])
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 64)
    for n in (300, 1200):
        joined(spark, large_group(n))
        made.append(None)
    small, large = (sum(made[: made.index(None)]), sum(x for x in made[made.index(None) + 1 :] if x))
    assert large < 8 * small  # in proportion 4, by the square 16


def test_difference_lemma_holds_for_every_linked_pair():
    r = np.random.default_rng(8)
    sketch = r.integers(0, 90, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    near = lambda x, y: 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
    seen = 0
    for _ in range(3000):
        c = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 90)), dtype=np.uint64))
        edit = lambda s: np.unique(np.concatenate([r.permutation(s)[int(r.integers(0, 1 + len(s) // 3)) :], r.integers(0, 1 << 63, int(r.integers(0, 1 + len(s) // 3)), dtype=np.uint64)]))
        x = edit(c)
        y = edit(x)
        if not len(x) or not len(y) or not near(x, y) or any(np.array_equal(a, b) for a, b in ((x, y), (x, c), (y, c))):
            continue
        (far, ps), (away, qs) = jaccard_join.difference(x, c, sketch), jaccard_join.difference(y, c, sketch)
        assert far == (not near(x, c)) and away == (not near(y, c))
        if far or away:
            seen += 1
            kinds = {k: (p, short, q, brief, max(sure, certain)) for k, p, short, _, sure in ps for j, q, brief, _, certain in qs if k == j}
            meet = {k: max(len(np.intersect1d(p[:short], q)), len(np.intersect1d(p, q[:brief]))) >= least for k, (p, short, q, brief, least) in kinds.items()}
            assert any(meet.values())
    assert seen > 200


def test_prefix_lemma_holds_for_every_linked_pair():
    r = np.random.default_rng(3)
    sketch = r.integers(0, 40, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(400):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        cut, more = int(r.integers(0, max(1, n // 6 + 1))), int(r.integers(0, max(1, n // 6 + 1)))
        y = np.unique(np.concatenate([r.permutation(x)[cut:], r.integers(0, 1 << 63, more, dtype=np.uint64)]))
        small, large = sorted((x, y), key=len)
        both = len(np.intersect1d(x, y))
        if not len(small) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        (p, short, k, _), (q, _, m, _) = jaccard_join.adaptive_prefix(small, sketch), jaccard_join.adaptive_prefix(large, sketch)
        need = -(-80 * (len(x) + len(y)) // 180)
        m_of = lambda i, s: min(jaccard_join.MATCHES[i], jaccard_join.required(len(s)))
        least = min(m_of(k, small) + need - jaccard_join.required_of_shorter(len(small)), m_of(m, large) + need - jaccard_join.required(len(large)))
        assert len(np.intersect1d(p[:short], q)) >= least >= 1


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    expected = grouped({x for e in edges for x in e}, edges)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in expected.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_vector_join_equals_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16))
    v = np.concatenate([r.standard_normal((300, 16)), np.repeat(base, 8, axis=0) + 0.2 * r.standard_normal((320, 16)), base[:3].repeat(5, axis=0)]).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    expected = grouped(range(len(v)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if b < a])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vector_join.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()) - 1, expected[i]) for i in range(len(v))}


def test_interval_join_skips_nothing(monkeypatch):
    monkeypatch.setattr(vector_join, "LEAF", 16)
    r = np.random.default_rng(1)
    a = vector_join.unit(np.concatenate([r.standard_normal((150, 9)), r.standard_normal((30, 9)).repeat(5, axis=0) + 0.1 * r.standard_normal((150, 9))]))
    found = set()
    vector_join.join_intervals(a, a, True, 0.9, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
    assert found == set(zip(*(x.tolist() for x in np.nonzero(np.triu(a @ a.T >= 0.9, 1)))))


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def plain_tree(streams, depth):
    """Counts of every context and decision node: {(context, node): [zeros, ones]}; contexts are nearest byte first."""
    counts = defaultdict(lambda: [0, 0])
    for s in streams:
        for i, byte in enumerate(s):
            past = bytes([0xFF]) * depth + s[:i]
            for d in range(depth + 1):
                context, node = past[::-1][:d], 1
                for bit in range(7, -1, -1):
                    counts[context, node][byte >> bit & 1] += 1
                    node = node << 1 | byte >> bit & 1
    return counts


def test_context_tree_equals_the_recursion(spark):
    texts = ["The cat sat on the mat", "the dog sat", "a cat  and\na dog", "", "dog cat dog cat"]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1][: len(texts)] + [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    texts += ["the cat zzz", "qqq"]
    stream = lambda t: " ".join(t.lower().split()).encode() + b"\xff"
    depth = context_tree.DEPTH
    counts = plain_tree([stream(t) for t in texts[:5]], depth)
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[:-1], node].append(context)

    def weighted(context, node):
        own = kt(*counts[context, node])
        if len(context) == depth:
            return own
        below = sum(weighted(c, node) for c in children[context, node])
        return math.log(0.5) + np.logaddexp(own, below)

    memo = {}

    def chance(past, node, d=0):
        """P(1) at a node: mixed over the depths of a path."""
        context = past[:d]
        a, b = counts[context, node] if (context, node) in counts else (0, 0)
        own = (b + 0.5) / (a + b + 1)
        deeper = past[: d + 1]
        if d == depth or (deeper, node) not in counts:
            return own
        if (context, node) not in memo:
            memo[context, node] = math.exp(math.log(0.5) + kt(a, b) - weighted(context, node))
        share = memo[context, node]
        return share * own + (1 - share) * chance(past, node, d + 1)

    got = {r["doc_id"]: r for r in context_tree.language_model(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    words = Counter(w for t in texts[:5] for w in [*t.lower().split(), None])
    n, v = sum(words.values()), len(words)
    for i, t in zip(ids, texts):
        s, total = stream(t), 0.0
        for k, byte in enumerate(s):
            past, node = (bytes([0xFF]) * depth + s[:k])[::-1][:depth], 1
            for bit in range(7, -1, -1):
                one = chance(past, node)
                total += math.log10(one if byte >> bit & 1 else 1 - one)
                node = node << 1 | byte >> bit & 1
        assert got[i]["score"] == pytest.approx(total, rel=1e-4)
        tokens = [*t.lower().split(), None]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(words[w] > 0 for w in tokens), n)


def test_word_hashes_do_not_depend_on_their_place():
    data = np.frombuffer("Ab cd\tAB\nab cdab ".encode(), np.uint8)
    h, at = word_hashes(data, np.array([0, 9, 9, len(data)]))
    assert at.tolist() == [0, 3, 3, 5] and h[0] == h[2] == h[3] and len(set(h.tolist())) == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1><nav><a href=x>Home</a> <a href=y>News</a></nav></header><div id="cookie-notice">We use cookies. By going on you agree to the use of cookies and so on, and so forth, for long.</div>
<div class="wrap"><div class="post"><h2>Title of it</h2><p>First long paragraph with many words, and it goes on &amp; on&#33; caf&eacute;</p><p>Short one.<ul><li>a point<li>another point</ul>
<p>Last   paragraph
 with <a href="z">a link</a> inside of it and some more words.</div><div class="sidebar"><h3>Related</h3><p>Related story that is quite long, with sentences. But no part of it.</p></div></div>
<section class="comments"><p>I disagree. It is very long and wrong in many ways, says a reader.</p></section><form><label>Name</label></form><footer><p>&copy; 2020 Somebody. All rights reserved.</p></footer></body></html>"""


def test_main_text_of_a_page():
    expected = ["Title of it", "First long paragraph with many words, and it goes on & on! café", "Short one.", "a point", "another point", "Last paragraph with a link inside of it and some more words."]
    assert html_text.main_text(PAGE).split("\n\n") == expected


def test_flow_is_a_least_cut():
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 7)
        score = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]
        flow = html_text.Flow(n + 2)
        for i, s in enumerate(score):
            flow.edge(n, i, s) if s > 0 else flow.edge(i, n + 1, -s)
        for i, j, w in edges:
            flow.edge(i, j, w, w)
        level = flow.run(n, n + 1)
        cost = lambda keep: sum(abs(s) for s, k in zip(score, keep) if (s > 0) != k) + sum(w for i, j, w in edges if keep[i] != keep[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost([level[i] >= 0 for i in range(n)]) == pytest.approx(best)


@needs_data
def test_articles_of_the_test_pages(spark):
    from html import unescape

    pages = table(spark, "pages")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)
        parts = [" ".join(unescape(re.sub(r"<[^>]*(>|\Z)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1])] if m else []
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    positive = np.array(labels) == 1
    p, n = positive.sum(), (~positive).sum()
    return (order[positive].sum() - p * (p - 1) / 2) / (p * n)


def test_ftrl_learns_held_out_toxicity(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows, marks = [], []
    for i in range(800):
        toxic = int(r.random() < 0.3)
        text = [word() for _ in range(30)]
        for _ in range(2 * toxic):
            text[r.randrange(30)] = r.choice(["Vile!", "nasty,", "rotten"])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert auc([x["score"] for x in held], [marks[x["doc_id"]][2] for x in held]) > 0.97
    kept = {x["doc_id"] for x in toxicity.clean(docs, labels).collect()}
    assert kept == {x["doc_id"] for x in got if not x["predicted"]}
    slots, weights, _ = toxicity.train(docs, labels, "toxic", F.lit(True))
    assert 0 < len(slots) < 500


def test_network_gradients_and_held_out_quality(spark):
    net = quality.Network(1)
    r = np.random.default_rng(0)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    chunks, first, y = r.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8), np.array([0, 2]), np.array([1.0, 0.0])
    loss = lambda: (lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())(net.combine(net.pool(chunks)[0], first)[0])
    grads = net.gradients(chunks, first, y)
    for name in ("filters", "dense", "out", "embed"):
        a = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(grads[name])), a.shape)
        old, step = a[at], 1e-5
        a[at] = old + step
        up = loss()
        a[at] = old - step
        down = loss()
        a[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grads[name][at], rel=0.05, abs=1e-6)


@needs_data
def test_quality_scores_cover_whole_texts():
    net = quality.Network(2)
    text = b"a" * 5000
    marked = text[:4990] + b"#" * 10
    for t in (text, marked):
        data, offsets = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        whole = quality.score_texts(net, data, offsets)
        assert whole.shape == (1,)
    assert quality.chunk_starts(5000)[-1] + quality.CHUNK >= 5000 and quality.chunk_starts(0).tolist() == [0]
    covered = np.zeros(5000, bool)
    for s in quality.chunk_starts(5000):
        covered[s : s + quality.CHUNK] = True
    assert covered.all()


def test_release_deletes_the_intermediate_tables(spark):
    from quirelight.llm import common

    kept = common.durable(spark.range(5), "kept")
    assert kept.count() == 5
    common.release(spark)
    with pytest.raises(Exception):
        common.durable(spark.range(5), "more").unionByName(kept).collect()
