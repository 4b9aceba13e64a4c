"""Encoding, repetition, mixing, mapping of typed values: round trips, brute force, odd input."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import regex

pytest.importorskip("graniva.llm")
from graniva.llm import queries as llm_queries
from graniva.llm.canonical import Matcher, map_cities, map_to_reference
from graniva.llm.encode import TOKENIZER, decode_corpus, encode_corpus, token_counts
from graniva.llm.mixing import mix_sources, plan_quotas, split_blocks
from graniva.llm.repetition import flag_repetition, most_repeated_words, repeated_words, repetition_shares

needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary files")
DOCS = "doc_id long, text string, lang string, source string, key string, word string, pos int"
TEXTS = [
    "Hello world, it's 2024!  Two  spaces.\n\n\tTabs　ideographic", "", None, " ", "\x85\xa0 ", "a" * 30_000, "ab " * 20_000,
    "这家店的蘑菇面味道很好。", "<|endoftext|> is text", "😀👍🏽 é ࢏\U0001fae8 \U00010ec2", "'s''ll I'LL we'd", "\x00\x1f￾", "Hello world, it's 2024!  Two  spaces.",
]


def docs(spark, texts, source=None, lang="en"):
    return spark.createDataFrame([(i, t, lang, source[i] if source else "s", "x", None, i) for i, t in enumerate(texts)], DOCS)


@needs_tokenizer
@pytest.mark.parametrize("limit,hot", [(48 << 20, 1000), (0, 10)])
def test_encoding_equals_the_tokenizer_and_decodes(spark, limit, hot):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    encoded = encode_corpus(docs(spark, TEXTS), limit=limit, hot_words=hot)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in decode_corpus(encoded).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in token_counts(docs(spark, TEXTS), ["doc_id"], limit=limit, hot_words=hot).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}


@needs_tokenizer
def test_encoding_of_empty_tables_and_repeated_ids(spark):
    assert encode_corpus(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in encode_corpus(twice).collect()) == [0, 1, 2, 2]


# -- repetition ------------------------------------------------------------------------------------


def brute(text, span=8):
    w = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+", (text or "").lower(), flags=regex.V1)
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - span + 1):
        g = tuple(w[i : i + span])
        if g in seen:
            mark[i : i + span] = [True] * span
        seen.add(g)
    return len(w), sum(mark)


def test_repetition_against_brute_force(spark):
    texts = [*TEXTS, "one two three four five six seven eight nine. " * 3, "好" * 20, "a b c d e f g h x a b c d e f g h", "One TWO three four five six seven eight, one two three four five six seven EIGHT"]
    rows = repetition_shares(docs(spark, texts), ["doc_id", "lang"]).collect()
    assert {r.doc_id: (r.n_words, r.repeated_words) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
    by = {r.doc_id: r for r in rows}
    assert by[2].word_share == 0 and by[len(TEXTS)].sentence_share == pytest.approx(2 / 3, abs=0.01)


def test_adaptive_thresholds(spark):
    texts = ["a b c d e f g h i j " * 2 if i % 10 == 0 else f"word{i} only once here" for i in range(60)]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    shares = repetition_shares(df, ["doc_id", "lang", "source"])
    flagged = {r.doc_id for r in flag_repetition(shares, ["lang", "source"], floor=0.3, ceiling=0.3).filter("flagged").collect()}
    assert flagged == {i for i, t in enumerate(texts) if brute(t)[1] / brute(t)[0] >= 0.3}
    adaptive = flag_repetition(shares, ["lang", "source"], quantile=0.5, floor=0.01, ceiling=0.9)
    assert adaptive.filter("lang IS NULL").select("threshold").distinct().count() == 1
    assert flag_repetition(repetition_shares(docs(spark, []), ["doc_id", "lang", "source"]), ["lang"]).count() == 0
    with pytest.raises(ValueError):
        flag_repetition(shares, ["lang"], floor=0.5, ceiling=0.3)


@pytest.mark.parametrize("sketch", [True, False])
def test_found_rows_come_through_the_sketch(spark, tmp_path, monkeypatch, sketch):
    texts = ["a b c d e f g h i j " * 3, "only once here", "k l m n o p q r " * 2, None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    asked = []

    def flag(shares, groups, **kw):
        asked.append((groups, kw))
        out = flag_repetition(shares, groups, **kw)
        return out if sketch else out.withColumn("flagged", out["flagged"] & (out["doc_id"] != 0))

    monkeypatch.setattr(llm_queries, "flag_repetition", flag)
    found = {r.doc_id for r in llm_queries.p10_found(spark, str(tmp_path)).collect()}
    assert found == ({0, 2} if sketch else {2})
    assert asked[0][0] == ["lang", "source"] and asked[0][1]["floor"] < asked[0][1]["ceiling"] <= 0.30


def test_shares_never_exceed_their_bounds():
    rng = np.random.default_rng(1)
    for i in range(4000):
        span, letters = int(rng.integers(1, 10)), int(rng.integers(1, 40))
        ids = rng.integers(0, letters, int(rng.integers(0, 60)))
        ids = np.concatenate([ids, ids[: int(rng.integers(0, 30))], ids[int(rng.integers(0, 30)) :]]) if i % 2 else ids
        assert repeated_words(ids, span) <= most_repeated_words([str(x) for x in ids], span) <= len(ids)
    assert most_repeated_words(list("abcdefgh" * 2), 8) == 8 and most_repeated_words(list("abcdefghijklmnop"), 8) == 0


def test_only_documents_above_the_threshold_are_measured(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 400, 40)) for _ in range(60)]
    some = [" ".join([*(f"v{x}" for x in range(n)), *(f"v{x}" for x in range(n - 12, n))]) for n in (26, 28, 29, 60, 90)]
    texts = [*plain, *some, *[f"{t} {t}" for t in plain[:5]], "a b c d e f g h " * 2, None, "", "a b c"]
    source = ["s" if i % 3 else None for i in range(len(texts))]
    docs(spark, texts, source).write.parquet(str(tmp_path / "documents.parquet"))
    measured = []

    def shares(df, *args, **kw):
        measured.extend(r.doc_id for r in df.select("doc_id").collect())
        return repetition_shares(df, *args, **kw)

    monkeypatch.setattr(llm_queries, "repetition_shares", shares)
    found = {r.doc_id for r in llm_queries.p10_found(spark, str(tmp_path)).collect()}
    assert found == {i for i, t in enumerate(texts) if t and brute(t)[1] / brute(t)[0] >= 0.3} and len(found) > 6
    assert found <= set(measured) and len(measured) == len(set(measured)) <= 15


# -- mixing ----------------------------------------------------------------------------------------


def test_quotas_fill_caps():
    q = {x.source: x for x in plan_quotas([("a", 0.5, 1), ("b", 0.5, 2), ("none", 0.1, 4)], {"a": 100, "b": 20})}
    assert q["a"].tokens == pytest.approx(40) and q["b"].tokens == pytest.approx(40) and q["none"].tokens == 0
    q = {x.source: x.tokens for x in plan_quotas([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 20}, 120)}
    assert q == {"a": pytest.approx(80), "b": pytest.approx(40)}
    q = {x.source: x.tokens for x in plan_quotas([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 100, "b": 20}, 10_000)}
    assert q == {"a": pytest.approx(100), "b": pytest.approx(40)}
    assert plan_quotas([], {}) == [] and plan_quotas([("a", None, None)], {"a": 5})[0].tokens == 0


def test_splitting_tree_keeps_counts():
    for shards in (1, 3, 8):
        deal = split_blocks([100, 7, 0, 33], shards, 4)
        assert deal.sum(0).tolist() == [100, 7, 0, 33] and (deal >= 0).all()
        assert np.ptp(deal.sum(1)) <= 4
    assert (split_blocks([50, 50], 4, 1) == split_blocks([50, 50], 4, 1)).all()


@needs_tokenizer
def test_mixture(spark):
    source = ["big" if i % 3 else "small" if i % 2 else None for i in range(600)]
    df = docs(spark, [f"text number {i} of the corpus" if i % 7 else None for i in range(600)], source)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2), (None, 0.1, 1), ("big", 0.5, 1)], "source string, target_share double, max_repeats long")
    mix, report = mix_sources(df, targets, shards=5)
    rows = mix.collect()
    used = Counter((r.doc_id, r.copy) for r in rows)
    assert max(used.values()) == 1 and max(r.copy for r in rows if r.source == "small") <= 3 and max(r.copy for r in rows if r.source == "big") == 1
    by = {r.source: r for r in report.collect()}
    assert by["absent"].used_tokens == 0
    assert by["big"].actual_share == pytest.approx(0.5, abs=0.01)
    for s in ("big", "small"):
        assert by[s].used_tokens == sum(r.n_tokens for r in rows if r.source == s)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.position)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in shards.values())
    again, _ = mix_sources(df.repartition(7), targets, shards=5)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


@needs_tokenizer
def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats long")
    mix, report = mix_sources(docs(spark, []), targets)
    assert mix.count() == 0 and [r.used_tokens for r in report.collect()] == [0]
    mix, report = mix_sources(docs(spark, ["a"]), targets.limit(0))
    assert mix.count() == 0 and report.count() == 0


# -- typed values ----------------------------------------------------------------------------------

NAMES = [(1, "Krieoska"), (2, "Port Krieoska"), (3, "North Naingen"), (4, "South Naingen"), (5, "Grumere-by-the-Weir"), (6, "Zygruoña"), (3, "Oldname")]


@pytest.mark.parametrize(
    "typed,want",
    [
        ("krieoska", 1), ("PORT  KRIEOSKA", 2), ("PortKrieoska", 2), ("Pt. Krieoska 12345", 2), ("Krieoska, Port", 2), ("near Krieoska", 1), ("City of Krieoska, QX", 1),
        ("N. Naingen", 3), ("So. Naingen", 4), ("Soth Naingen", 4), ("Kri3osk4 - YL", 1), ("Kriеoska", 1), ("Zygruona", 6), ("Grumere by thee Weir", 5), ("Krieosska", 1), ("oldname", 3),
        ("West Naingen", 0), ("Lake Krieoska", 0), ("unknown", 0), ("12345", 0), ("??", 0), ("N/A", 0), ("448 Prulthy Street", 0), ("", 0), ("x" * 5000, 0),
    ],
)
def test_typed_values(typed, want):
    assert Matcher(NAMES)(typed)[0] == want


PROBES = [(1, "Krieoska"), (2, "Krieoskb"), (3, "West Ur"), (4, "1770"), (5, "Salemar"), (6, "Saiemar"), (7, "San Jose del Monte"), (8, "Upper Kemjaholm"), (8, "Breaona"), (9, "Kemjaholm"), (10, "Lower Kemjaholm")]
PROBED = [
    ("Krieoskx", 0), ("West QX", 0), ("West Ur", 3), ("1770", 4), ("Krieoska 1770", 1), ("Salemar", 5), ("Saiemar", 6), ("Sa1emar", 0), ("Monte San Jose", 7), ("San Jose", 0),
    ("Up. Kemjaholm", 8), ("Upr Kemjaholm QX", 8), ("Kemjaholm, Upper", 8), ("UpperKemjahollm", 8), ("Kemjaholm", 9), ("Brea0na 55443", 8), ("Upper Kemjaholm Airport", 8), ("Salemar Krieoska", 0),
]


@pytest.mark.parametrize("block", [50_000, 3, 1])
def test_probes_have_one_answer_whatever_the_block(spark, block):
    ref = spark.createDataFrame(PROBES, "id long, name string")
    df = spark.createDataFrame([(t, 5) for t, _ in PROBED], "typed string, name long")
    got = {r.typed: r.id for r in map_to_reference(df, "typed", ref, "id", "name", block=block).collect()}
    assert got == dict(PROBED)


@pytest.mark.parametrize("block", [50_000, 2])
def test_mapping_of_a_table(spark, block):
    ref = spark.createDataFrame([(1, "Krieoska", ["Altname"]), (2, "Port Krieoska", None), (3, None, [None, "Third"])], "city_id long, city string, other_names array<string>")
    df = spark.createDataFrame([("a", "altname", 9), ("b", "Pt Krieoska", 9), ("c", None, 9), ("d", " 　", 9), ("e", "third", 9), ("f", "nowhere", 9), ("a", "altname", 9)], "business_id string, city string, id int")
    got = {r.business_id: r.city_id for r in map_to_reference(df, "city", ref, "city_id", "city", "other_names", block=block).collect()}
    assert got == {"a": 1, "b": 2, "c": None, "d": None, "e": 3, "f": 0}
    assert map_cities(df, ref).count() == 4
    assert {r.city_id for r in map_cities(df, ref.limit(0)).collect()} == {0}
    assert map_cities(df.limit(0), ref).count() == 0
