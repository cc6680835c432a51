"""Long runs of one character, rows without ids in the mix, the matcher against a plain search, users' columns."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caselake.llm import mixing, packing, token_counts, tokens, toxicity


@pytest.mark.parametrize("sign", [" ", "\t", "\n", " ", "a", "1", ".", "é", "語"])
def test_five_megabytes_of_one_character(sign):
    text = sign * (5_000_000 // len(sign.encode()))
    encoder = tokens.encoder()
    ids = encoder.encode(text)
    assert int(encoder.byte_ends(ids)[-1]) == len(text.encode()) and encoder.decode(ids) == text


def test_cut_blanks_leave_the_tokens_as_they_are():
    encoder, rng = tokens.encoder(), random.Random(1)
    for _ in range(100):
        text = "".join(rng.choice(["a", "b ", "\n", " " * rng.choice([1, 3, 9999, 10000, 12000]), "\t" * 10050, "x1!", " \n" * 6000, "\xa0" * 10003]) for _ in range(rng.randint(1, 8)))
        assert encoder.encode(text).tolist() == encoder._encoding.encode_ordinary(text)


def test_blanks_pass_packing_and_counting(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_100_000 + "\nb"), (2, " " * 1_100_000)], "doc_id long, text string")
    want = sum(len(tokens.encoder().encode(r["text"])) for r in docs.collect())
    packed = packing.pack(docs, length=512, end_token=False).select(F.element_at("cu_seqlens", -1).alias("n")).collect()
    assert sum(r["n"] for r in packed) == want
    assert token_counts.count_sections(docs).agg(F.sum("n_tokens")).first()[0] == want


def mixed_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _copies long, _source string, tags map<string,string>")
    out = mixing.mix(df)
    assert out.columns == df.columns
    taken, sizes = Counter(), Counter()
    for r in out.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    spark_sizes = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    return taken, {r["source"]: r["target"] for r in mixing.source_targets(spark_sizes).collect()}, out


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_meets_its_targets_whatever_the_ids(spark, doc_id):
    rows = [(doc_id, " ".join(["w"] * 10) + ("" if k % 3 else f" {k}"), "ab"[k % 2], k, 1, None, {"k": "v"}) for k in range(120)]
    taken, targets, _ = mixed_words(spark, rows)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 5.5


def test_mix_counts_rows_that_agree_in_all(spark):
    rows = [(None, "one two three", "a", None, None, None, None)] * 50 + [(None, "four five", "b", 1, None, None, None)] * 400 + [(3, None, "c", 1, None, None, None), (4, " ", "c", 1, None, None, None)]
    taken, targets, out = mixed_words(spark, rows)
    assert abs(taken["a"] - targets["a"]) <= 1.5 and abs(taken["b"] - targets["b"]) <= 1
    assert out.filter("source = 'c'").count() == 2
    assert Counter(map(str, out.collect())) == Counter(map(str, mixed_words(spark, rows[::-1])[2].collect()))


def plain_measure(lexicon, text):
    """Every term at every place of the folded text; the strongest of each place; none inside an exception."""
    words = toxicity.fold(text)
    line = f" {' '.join(words)} "
    covered = set()
    for phrase in toxicity.EXCEPTIONS:
        p = f" {' '.join(toxicity.fold(phrase))} "
        covered |= {i for at in range(len(line)) if line.startswith(p, at) for i in range(at, at + len(p) - 1)}
    best = defaultdict(float)
    for term, weight in lexicon.items():
        for at in range(len(line)):
            if line.startswith(term, at):
                best[at] = max(best[at], weight)
    return sum(w for at, w in best.items() if at not in covered), len(words)


def test_matcher_equals_a_plain_search():
    rng = random.Random(4)
    words = ["trash", "can", "clown", "fish", "tr4sh", "сlоwn", "idiot", "1d1ot", "idiotic", "class", "ab", "Trash-can", "ﬁsh", "x​y"]
    for _ in range(300):
        known = {f" {''.join(toxicity.fold(w))}{rng.choice(['', ' '])}": rng.uniform(0.5, 4) for w in rng.sample(words, 5)}
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        total, n = toxicity.Matcher(known).measure(text)
        want = plain_measure(known, text)
        assert n == want[1] and abs(total - want[0]) < 1e-9, text


def test_drop_toxic_keeps_a_users_column(spark):
    rows = [(k, "you idiot fool " * 5 if k % 2 else "a calm walk by the sea", 0.25) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _toxicity double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["_toxicity"] for r in kept.collect()} == {0.25} and kept.filter("doc_id % 2 = 0").count() == 40


def test_ids_beyond_the_width_are_an_error(spark):
    rows = spark.createDataFrame([([70_000], [0, 1], [0], [1], [0])], "input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, parts array<int>")
    assert packing.as_binary(rows, "<u4").first()["input_ids"] == bytearray((70_000).to_bytes(4, "little"))
    with pytest.raises(Exception, match="needs more than"):
        packing.as_binary(rows).collect()
