"""Source divergence, MinHash near-dedup and tokenizer alignment against brute force, on nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glosswork.llm import align, divergence, minhash

DOCS = "doc_id long, text string, lang string, source string"
CLASHING = ("row", "n", "member", "component", "rank", "term", "terms", "digest", "copies", "pairs", "code", "tokens", "value", "item", "key")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASHING})


def prose(rng, n, words=40):
    return " ".join(f"w{chr(97 + rng.randrange(words) % 26)}{'aeiou'[rng.randrange(words) % 5]}{'' if words < 100 else rng.randrange(words)}" for _ in range(n))


# --- source divergence


def brute_divergence(rows, least=10):
    docs = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    found = [collections.Counter(re.findall(rb"[A-Za-z\x80-\xff]+", t.encode().lower())) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held = collections.Counter(x for (_, g, _), c in zip(docs, found) if g == lang for x in c)
        kept = sorted(x for x, n in held.items() if n >= least)
        sources = sorted({s for _, g, s in docs if g == lang})
        count = {s: collections.Counter() for s in sources}
        for (_, g, s), c in zip(docs, found):
            if g == lang:
                count[s].update({x: n for x, n in c.items() if x in set(kept)})
        whole = sum(count.values(), collections.Counter())

        def p(c):
            total = sum(c.values()) + 2 * len(kept)
            return {x: 1 + 10**9 * (c[x] + 2) // total for x in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(count[s]) for s in sources}, p(whole)
        for s in sources:
            pair = [(-sum(f(ps[s][x], ps[o][x]) for x in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(ps[s][x], q[x]), x, x.decode()) for x in kept if count[s][x] and ps[s][x] > q[x]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", o, -v, k) for k, (v, _, o) in enumerate(sorted(term)[:10], 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        text = prose(rng, rng.choice([0, 1, 5, 30, 200])) + rng.choice(["", " Straße über ÉCOLE école", " don't x1y2", "\x00@a[b`c{d"])
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s10", "s2", "é", None])))
    rows += [(1000, "hot copy of a text", "en", "s1")] * 150 + [(None, "hot copy of a text", "en", "s2")] * 40 + [(None, None, "en", None)] * 3
    rows += [(2000, "lone words", "fr", "only"), (2001, prose(rng, 30_000), "en", "s2"), (2002, "q" * 300_000, "xx", "a"), (2003, "short", "xx", "b")]
    got = [tuple(r) for r in divergence.divergence(docs_of(spark, rows).repartition(5)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_divergence(rows)
    assert [r for r in got if r[0] == "xx"] and all(r[4] == 0 for r in got if r[0] == "xx")  # no kept terms
    assert not [r for r in got if r[0] == "fr"]  # one source


def test_divergence_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    rows = [(i, prose(rng, 40), "en", f"s{rng.randrange(4)}") for i in range(60)]
    got = [tuple(r) for r in divergence.divergence(docs_of(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_divergence(rows)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(docs_of(spark, [(1, "a", "b", "c")]).limit(0)).count() == 0


def test_probabilities_are_exact_beyond_64_bits(spark):
    n, total, v = 9 * 10**12 + 7, 10**13 + 1, 12_345
    got = spark.sql(f"select {divergence._p('n', 'total', 'v')} from values ({n}L, {total}L, {v}L) as t(n, total, v)").first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_equal_texts_are_read_once(spark):
    rows = [(i, "same text", "en", f"s{i % 3}") for i in range(30)] + [(99, "same text", "de", "s0")]
    got = divergence.collapsed(docs_of(spark, rows)).collect()
    assert sorted((r["lang"], sorted((s["source"], s["copies"]) for s in r["sources"])) for r in got) == [("de", [("s0", 1)]), ("en", [("s0", 10), ("s1", 10), ("s2", 10)])]


# --- MinHash near-dedup


def brute_near(rows, width=3, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(r[0], len(s), rows[find(k)][0], rows[find(k)][0] == r[0]) for k, (r, s) in enumerate(zip(rows, sets))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """Copies at and around the similarity: replacing one word changes three shingles."""
    rng, texts = random.Random(6), []
    for size in (3, 8, 9, 20, 21, 40, 80, 300):
        for _ in range(12):
            base = prose(rng, size, 900).split()
            texts.append(base)
            texts += [edited(rng, base, rng.choice([0, 1, 1, 2, 3, size // 20])) for _ in range(rng.choice([1, 2, 4]))]
    base = prose(rng, 120, 900).split()
    chain = [base]
    for _ in range(120):  # a large group of copies of copies
        chain.append(edited(rng, rng.choice(chain), rng.choice([0, 1, 2, 4])))
    texts = [" ".join(t) for t in texts + chain] + [None, "", " \n ", "Same SAME words", "same same WORDS", prose(rng, 20_000, 900)]
    rng.shuffle(texts)
    return [(i, t, "en", "s0") for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [2, 12, 500])
def test_near_duplicates(spark, monkeypatch, copies, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    got = sorted(map(tuple, minhash.near_duplicates(docs_of(spark, copies).repartition(6)).collect()))
    want = brute_near(copies)
    assert got == want
    assert 100 < sum(k for *_, k in want) < len(want) - 50


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_of(spark, [(1, "a", "b", "c")]).limit(0)).count() == 0
    t = "one two three four five six seven eight nine ten"
    rows = [(None, t), (None, t), (7, t), (7, t), (3, t + " eleven"), (None, "quite another text of words"), (None, None), (9, None), (5, "one"), (4, "ONE"), (8, "one two"), (4, "one")]
    got = sorted(map(tuple, minhash.near_duplicates(docs_of(spark, [(*r, "en", "s") for r in rows])).collect()), key=str)
    want = [(None, 8, 3, False)] * 2 + [(7, 8, 3, False)] * 2 + [(3, 9, 3, True), (None, 3, None, False), (None, 0, None, False), (9, 0, 9, True), (5, 1, 4, False), (4, 1, 4, True), (4, 1, 4, True), (8, 1, 8, True)]
    assert got == sorted(want, key=str)


def test_rare_misses_are_as_rare_as_said():
    from math import comb

    missed = sum(comb(minhash.COORDINATES, k) * 0.85**k * 0.15 ** (minhash.COORDINATES - k) for k in range(minhash.MATCHES))
    assert missed < 1 / (9 * 10**8) * 1.1


# --- tokenizer alignment

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def brute_alignment(rows):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    at = align._byte_level()
    names = {i: bytes(at[c] for c in piece) for piece, i in slow.get_vocab(with_added_tokens=False).items() if piece != "<|endoftext|>"}
    encode_b, pieces = align.load_pieces(B)
    out, held = [], collections.Counter()
    for doc_id, text, *_ in rows:
        a = slow.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = encode_b([text])[0].tolist() if text else []
        data = b" " + (text or "").encode()
        if not text or b"".join(names[i] for i in a) != data or b"".join(pieces[i] for i in b) != data:
            out.append((doc_id, [], [], [], collections.Counter()))
            continue
        groups, i, j, x, y = [], 0, 0, 0, 0
        while i < len(a):  # two pointers over both token lists
            left, right = [], []
            while True:
                if x <= y and not (x == y and left):
                    x += len(names[a[i]])
                    left.append(a[i])
                    i += 1
                else:
                    y += len(pieces[b[j]])
                    right.append(b[j])
                    j += 1
                if x == y and left and right:
                    break
            groups.append((left, right))
        links = collections.Counter()
        for left, right in groups:
            for p, n in collections.Counter(left).items():
                for q, m in collections.Counter(right).items():
                    links[p, q] += n * m
        held.update(links.keys())
        out.append((doc_id, a, b, groups, links))
    best = collections.Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    wanted = []
    for doc_id, a, b, groups, links in out:
        name = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        wanted.append((doc_id, len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(name.encode()).hexdigest() if a else ""))
    return sorted(wanted, key=str)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    texts = [None, "", " ", "a", "  two  spaces\n\n\tand a tab ", "▁marked▁", "<s> <|endoftext|> </s> <unk> <0x41>", "x\x00y", "naïve Straße 東京 🙂🙂 é", "\r\n", "12345 67.89", "　wide ", "don't we'll THE the", "ﬁ ½ Ａ"]
    texts += [prose(rng, rng.choice([1, 5, 60]), 900) + rng.choice(["", " — the end.", "東京 x", "  "]) for _ in range(40)]
    texts += ["ab" * 20_000, "qzxj" * 3_000 + " a", prose(rng, 6_000, 900), "東" * 5_000, "🙂" * 2_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [(3, "a", "en", "s")] * 3 + [(None, "the end", "en", "s")] * 2


@pytest.mark.parametrize(("most", "held", "wide"), [(1_000_000, 1 << 20, 4096), (100, 300, 2), (0, 1 << 20, 4096)])
def test_alignment(spark, monkeypatch, odd_texts, most, held, wide):
    monkeypatch.setattr(align, "HELD", held)
    monkeypatch.setattr(align, "WIDE", wide)
    monkeypatch.setattr(align, "RUN_BYTES", 20_000)
    got = sorted(map(tuple, align.alignment(docs_of(spark, odd_texts).repartition(4), A, B, most).collect()), key=str)
    assert got == brute_alignment(odd_texts)


def test_alignment_of_an_empty_table(spark):
    assert align.alignment(docs_of(spark, [(1, "a", "b", "c")]).limit(0), A, B).count() == 0


def test_ids_follow_the_file(tmp_path):
    """A file whose ids don't follow its merges is read by its own encoder, with the same bytes."""
    saved = json.load(open(A, encoding="utf-8"))
    vocab = saved["model"]["vocab"]
    one, two = sorted(vocab, key=vocab.get)[300:302]
    vocab[one], vocab[two] = vocab[two], vocab[one]
    other = tmp_path / "swapped.json"
    other.write_text(json.dumps(saved), encoding="utf-8")
    texts = ["the quick brown fox, naïve 東京 <|endoftext|>", "  x\n\n"]
    (fast, pieces), (slow, swapped) = align.load_byte_level(A), align.load_byte_level(str(other))
    for p, q, t in zip(fast(texts), slow(texts), texts):
        assert b"".join(pieces[i] for i in p) == b"".join(swapped[i] for i in q) == b" " + t.encode()
        assert [pieces[i] for i in p] == [swapped[i] for i in q]
