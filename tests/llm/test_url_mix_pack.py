"""Url rules, mixing and packing on small tables, against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bytewright.llm import mixing, packing, url_rules

DOCS = "doc_id long, text string, source string"


def test_url_rules(spark):
    urls = ["http://a.Example.COM/en/77?x", "https://example.com/en/8", "http://xexample.com/en/7", "ftp://de.example.net/de/8#t", "x://net/de/1", "none", None, "", "http://", "http://a.org/es/?://b", "http://example.com/en/77", "http://example.com/en/77"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    want = [("a.example.com", "/en/77", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("xexample.com", "/en/7", "com/en/", "block"), ("de.example.net", "/de/8", "example.net/de/8", "block"), ("net", "/de/1", "net/de/", "allow")]
    want += [("", "", None, "allow")] * 4 + [("a.org", "/es/", "org/es/", "block")] + [("example.com", "/en/77", "example.com/en/7", "allow")] * 2
    for inline in (256, 0):  # the literal map and the join
        got = url_rules.judge_urls(spark, df, url_rules.RULES, inline=inline).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want


def test_url_rules_without_tokens(spark):
    df = spark.createDataFrame([(1, "http://h.x/abc"), (2, "http://x/ab")], "page_id long, url string")
    got = url_rules.judge_urls(spark, df, [("", "/abc", "block"), ("", "", "allow")]).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("/abc", "block"), ("", "allow")]


def test_mix_against_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(0, 60))) or None, ["a", "b", "c", None, ""][int(rng.integers(0, 5))]) for i in range(400)] + [(7, "twice here", "a"), (7, "twice here", "a"), (None, "x y z", "b")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(mixing.sized(df).drop("text")).collect()
    assert len(got) == len(rows)
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += len((t or "").split())
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(words.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * words[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * words[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == words[s] and abs(r.target - target[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    key = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert key(mixing.mix(mixing.sized(df.repartition(7)).drop("text")).collect()) == key(got)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (None, None, "a")]])
def test_mix_of_nothing(spark, rows):
    got = mixing.mix(mixing.sized(spark.createDataFrame(rows, DOCS)).drop("text")).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)


def _check_pieces(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and zlib.crc32(ids[i][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_pack(spark):
    odd = ["a\x1cb c", "a\x85b\xa0c", "don't 'stop'", "<|endoftext|> x", "İstanbul ΣΑΣ", "e\u0301 \u0301x", "", None, "word, word. word!", "é ß ﬁ 한글 漢字\u200b", "x" * 30_000, "the " * 9000]
    texts = list(enumerate(odd)) + [(100 + i, "some more words here " * (i * 7 % 300)) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for parts in (1, 3):
        _check_pieces(packing.pack_documents(df.repartition(parts), packing.tokenizer_file()).collect(), texts)


def test_pack_of_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, start int, sequence_id string")
    assert packing.pack_documents(df, packing.tokenizer_file()).collect() == []
    df = spark.createDataFrame([(None, None, 5, "x")] * 2, df.schema)
    assert sorted(r.offset for r in packing.pack_documents(df.coalesce(1), packing.tokenizer_file()).collect()) == [0, 1]


def test_levels_minimise_squares():
    p = packing.Packer(16, 0)
    p.counts[[3, 5, 9]] = [4, 1, 2]
    for n in range(1, 17):
        best = {}
        for h in [0, 3, 5, 9]:
            if h + n <= 16:
                c = p.counts.copy()
                c[h] -= h > 0
                if h + n < 16:
                    c[h + n] += 1
                best[h] = int((c**2).sum())
        low = min(best.values())
        assert p._level(n) == max(h for h, v in best.items() if v == low)


ALPHABETS = ("abcdeABCDE", "éèöüßçñÀÇÑÜµªº", "İıŞşĞğ", "αβγΩΣς", "абвгЯЖё", "e\u0301o\u0308a\u030a", "漢字かなカナ", "ﬁﬂ①Ⅳ½", "0123456789", ".,!?;:'\"()-_@#/&")


def test_ids_of_fuzzed_texts():
    """Against one call of the tokenizer for each text."""
    rng = random.Random(9)
    ids = packing.Ids(packing.tokenizer_file())
    texts = ["İ,", "ß.", "ÇA, é!", "a\u0301, b", "\x1c a", "<|x|> y"]
    for _ in range(20_000):
        letters = "".join(rng.sample(ALPHABETS, rng.choice((1, 1, 2, 3)))) + ".,!"
        texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 5))))
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        plain = [b"".join(int(i).to_bytes(4, "little") for i in e.ids) for e in ids.encoder.encode_batch(part, add_special_tokens=False)]
        assert [t for t, x, y in zip(part, ids.of(part), plain) if x != y] == []


def test_most_tokens_stay_where_they_were_placed():
    rng = random.Random(3)
    packer, rows, total = packing.Packer(4096, 0), [], 0
    for d in range(3000):
        n = min(12_000, int(rng.expovariate(1 / 700)) + 1)
        total += n
        rows += packer.add(d, bytes(4 * n))
    rows += packer.finish()
    sizes = Counter()
    for _, _, n, _, _, number, offset in rows:
        assert offset == sizes[number]
        sizes[number] += n
    assert sum(sizes.values()) == total and all(n & (n - 1) == 0 for n in sizes.values())
    assert packer.cut < 0.2 * total


def test_simple_words_are_not_normalised_again(monkeypatch):
    """Words of ASCII and Latin-1 letters, digits and marks cost the model alone; all ids are those of one call for each text."""
    rng = random.Random(4)
    ids = packing.Ids(packing.tokenizer_file())
    texts = ["'s", "don't. ", "$$$. x", "x_. y", "a.. b", "1. 2, ", ". x", "x .\n, y", "Æß'LL'. ¿qué? À.", "ª. b", "x's, y's.\tz", "été.\r\nÀÿß, x!, "]
    for _ in range(20_000):
        texts.append("".join(rng.choice(("a", "Be", "é", "ß", "Ñ", "ÿ", "7", "42", ".", ",", "'", "'s", "'RE", "_", "$", "!", "-", " ", " ", " ", "\n", "\t", "\xa0")) for _ in range(rng.randint(1, 14))))
    plain = [np.array(e.ids, "<u4").tobytes() for e in ids.encoder.encode_batch(texts, add_special_tokens=False)]
    asked = []
    encode = packing.Ids._encode
    monkeypatch.setattr(packing.Ids, "_encode", lambda self, x: asked.append(x) or encode(self, x))
    assert [t for t, x, y in zip(texts, ids.of(texts), plain, strict=True) if x != y] == []
    assert asked == ["¿qué?", "ª."]


def test_memory_of_long_words():
    """They are encoded whole, and not kept."""
    import tracemalloc

    ids = packing.Ids(packing.tokenizer_file())
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5_000)) for _ in range(1_000)]
    want = [np.array(ids.encoder.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words[:5]]
    assert list(ids.of(words[:5])) == want
    tracemalloc.start()
    for w in words:
        list(ids.of([w]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000
