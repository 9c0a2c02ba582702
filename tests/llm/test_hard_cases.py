"""Hard cases of the training-data operators: broken markup, repeated ids, long items, dense hits, clashing names."""

from __future__ import annotations

import collections
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .labelled_pages import PAGES

WORDS = [a + b for a in ("ka", "re", "to", "mi", "sol", "un", "der") for b in ("", "la", "ne", "st", "x")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_precision_and_recall_by_block_on_pages_written_by_hand():
    from silvaspark.llm.html_text import blocks, trained

    model, tally = trained(), collections.Counter()
    for page in PAGES:
        leaves = blocks(page, labelled=True)
        assert all(b.label >= 0 for b in leaves)
        tally.update(zip(model.viterbi(leaves), (b.label for b in leaves), strict=True))
    precision, recall = tally[1, 1] / (tally[1, 1] + tally[1, 0]), tally[1, 1] / (tally[1, 1] + tally[0, 1])
    assert precision >= 0.95 and recall >= 0.95, (precision, recall)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p title=it's>One two three, four five. I don't know that.</p><p>Tail of it, and so on.</p></article>", "One two three, four five. I don't know that. Tail of it, and so on."),
        ('<article><table><tr><td data-label="Price">Ten dollars, more or less</td></tr></table><p>Some words, that say it.</p></article>', "Ten dollars, more or less Some words, that say it."),
        ('<article><p a="x>y" b=\'>\' c=">">Quoted ends, in attributes.</p></article>', "Quoted ends, in attributes."),
        ("<article><p>Sums: 3 < 4, and 5 > 2, as ever.</p><!-- <p>no --></article>", "Sums: 3 < 4, and 5 > 2, as ever."),
        ("<article><p>Energy is <math><mi>E</mi></math>, as <map>we</map> know.</p></article>", "Energy is E, as we know."),
        ("<title>x</title><p>The head was left out, and some text is here.</p>", "The head was left out, and some text is here."),
        ("<head><title>x</title><p>The head was left open, and some text is here.</p>", "The head was left open, and some text is here."),
        ("<article><p>The last tag is cut off, by the end.</p><p class='", "The last tag is cut off, by the end."),
    ],
)
def test_markup_loses_no_text(page, want):
    from silvaspark.llm.html_text import main_text, trained

    assert main_text(page, trained()) == want


def test_markup_is_read_in_linear_time():
    from silvaspark.llm.html_text import main_text, trained

    model = trained()
    bad = ['<a "' * 20000, "<a " * 20000, "<div>" * 20000 + "x" + "</p>" * 5000 + "</section>" * 5000, "<li><ul>" + "<div>" * 20000 + "<li>a</li>" * 5000, "<!--" * 20000, "</" * 50000, "<![CDATA[" * 20000, "<p a='" * 20000, "<script>" * 20000, "&" * 200000, "< " * 100000, "<a b" + " " * 100000 + "=" + " " * 100000, "<a " + "b= " * 50000, "<table><tr><td>" * 10000]
    for page in bad:
        began = time.process_time()
        main_text(page, model)
        assert time.process_time() - began < 3, page[:20]


def test_lines_of_rows_that_repeat_a_doc_id(spark, docs):
    """Each row is known by its doc_id and text; brute force in the order of (doc_id, hash of the text, line)."""
    from silvaspark.llm.line_dedup import dedup_lines

    a, b, c = "one two three four five", "six seven eight nine ten", "red green blue black white"
    rng = random.Random(3)
    pool = [a, b, c, *(text(rng, 9) for _ in range(8)), a + " six", "x " + b]
    rows = [(1, a), (5, b), (5, c + "\n" + a), (5, b), (None, a + " extra"), (None, ""), (2, None)]
    rows += [(rng.randrange(6, 12), "\n".join(rng.sample(pool, rng.randrange(1, 5)))) for _ in range(40)]
    df = docs(rows)
    order = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    seen, want = [], collections.Counter()
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r])):
        keep = []
        for line in t.split("\n") if t is not None else []:
            s = frozenset(line.split())
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                keep.append(line)
            if s:
                seen.append(s)
        want[i, "\n".join(keep) if t is not None else None] += rows.count((i, t))
    assert collections.Counter((r.doc_id, r.text) for r in dedup_lines(df).collect()) == want


@pytest.mark.parametrize("size", [150, 300])
def test_long_lines_that_are_unlike_are_not_verified(spark, docs, monkeypatch, size):
    """Lines of many common words share prefix words, but only the planted near copies are compared as whole sets."""
    from silvaspark.llm import line_dedup

    rng = random.Random(size)
    vocabulary = ["w" + str(i) for i in range(size * 3)]
    lines = [" ".join(rng.sample(vocabulary, rng.randrange(size - 9, size))) for _ in range(120)]
    near = [line.rsplit(" ", 3)[0] + " new" for line in lines[:10]]
    verified, similar = [], line_dedup._similar

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    out = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(docs(list(enumerate(lines + near)))).collect()}
    assert out == {i: int(i < len(lines)) for i in range(len(lines) + len(near))}
    assert sum(verified) < 2 * len(near)


def test_units_are_looked_up_once_for_many_texts():
    """Plain and odd texts in one call give the library's ids, and a unit costs no look-up for each time that it stands there."""
    import public_tokenizers

    from silvaspark.llm import token_records as tr

    class Counted(dict):
        looked_up = 0

        def __contains__(self, key):
            Counted.looked_up += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counted.looked_up += 1
            return super().__getitem__(key)

    rng = random.Random(8)
    enc = tr.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.after = Counted()
    plain = [text(rng, 300) for _ in range(60)]
    odd = ["", " ", "\n", " a", "a ", "a\n", "\na b", "a\n\nb  c", "x\u3000y\tz", "a\x1cb c", "<|endoftext|> a <|endoftext|>", "é\u0301 🎉\n日本 ", "a\x00b c"]
    texts = [x for pair in zip(plain, odd * 5, strict=False) for x in pair]
    assert enc.encode(texts) == enc.whole(texts)
    assert Counted.looked_up < 1000 < sum(len(t.split()) for t in texts) / 10
    assert enc.encode([""]) == [b""] and enc.encode([]) == []
    batch = pa.record_batch([pa.array([None, "", "a" * (9 << 20), "b", None, "c" * (5 << 20), "d" * (5 << 20)])], names=["text"])
    assert [s.num_rows for s in tr.slices(batch, 0)] == [2, 1, 2, 1, 1] and pa.Table.from_batches(tr.slices(batch, 0)).combine_chunks().to_batches()[0] == batch


def test_states_of_many_rare_words_are_determinised_once(monkeypatch):
    """A worker holds the states that some ten thousand unlike words reach; counts are the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from silvaspark.llm.token_counts import Counter

    path = public_tokenizers.path("word_bpe_49k.json")
    rng, lib, counter = random.Random(9), Tokenizer.from_file(path), Counter(path)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(15_000)]
    first = [counter.transducer.count(w.encode()) for w in words]
    assert len(counter.transducer.states) > 60_000
    assert first == [len(e.ids) for e in lib.encode_batch(words, add_special_tokens=False)]
    monkeypatch.setattr(counter.transducer, "_determinise", None)
    assert [counter.transducer.count(w.encode()) for w in words] == first


def test_classes_of_very_common_tokens_keep_their_order(spark):
    """Ranks stay positive in the highest class, so that the commonest tokens sort last."""
    from silvaspark.llm.line_dedup import CLASSES

    assert spark.range(1).select(F.shiftleft(F.lit(CLASSES).cast("long"), 58).alias("x")).first().x > 0


def test_a_long_item_changes_nothing_for_short_ones(spark, docs):
    from silvaspark.llm import decontaminate as dc

    rng = random.Random(4)
    fresh = lambda n: " ".join("w" + str(rng.randrange(10**5)) for _ in range(n))
    short = [(i, fresh(30) + ". " + fresh(5) + ".") for i in range(20)]
    long = (99, fresh(3000) + ". " + fresh(9) + ".")
    # the question at one place and the answer 900 words away is no copy, however long other items are
    far = [(100 + i, t.split(". ")[0] + " " + fresh(900) + " " + t.split(". ")[1]) for i, t in short]
    rows = [(i, fresh(200) + " " + t + " " + fresh(200)) for i, t in short] + [(500, fresh(70) + " " + long[1])]
    make = lambda items: spark.createDataFrame(items, "item_id long, text string")
    hits = lambda items: {(r.doc_id, r.item_id): r.first_word for r in dc.contamination(docs(rows + far), make(items)).collect()}
    alone, both = hits(short), hits([*short, long])
    assert (500, 99) in both and {k: v for k, v in both.items() if k[1] != 99} == alone
    assert {(i, i) for i in range(20)} <= set(alone)


def test_decontamination_against_brute_force(spark, docs):
    """BM25 scores of every item and window by plain sums, then the overlaps, on copies that are cut to all lengths."""
    from silvaspark.llm import decontaminate as dc

    rng = random.Random(5)
    vocabulary = ["t" + str(i) for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(4)) + ".") for i in range(25)]
    rows = []
    for j in range(80):
        w = items[j % 25][1].split(" ")
        some = w[: max(1, len(w) * (j % 10 + 1) // 10)]
        rows.append((j, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))) + " " + " ".join(some) + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 200)))))
    split = [(i, *dc.question_answer(t)) for i, t in items]
    every = [np.concatenate([dc.words(q), dc.words(a)]) for _, q, a in split]
    df, mean = collections.Counter(t for w in every for t in set(w.tolist())), sum(map(len, every)) / len(every)
    idf = {t: np.log(1 + (len(every) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    want = set()
    for doc, t in rows:
        w = dc.words(t)
        for (i, q, a), own in zip(split, every, strict=True):
            weight = {x: idf[x] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / mean)) for x, f in collections.Counter(own.tolist()).items()}
            step = dc.span(len(own))
            for s in range(0, max(1, len(w) - step), step):
                passage = w[s : s + 2 * step]
                there = set(passage.tolist())
                if sum(x for k, x in weight.items() if k in there) < 0.5 * sum(weight.values()) - 1e-9:
                    continue
                share = lambda x, y: np.isin(np.unique(x), y).mean() if len(x) else 1.0
                grams = lambda x, n: dc.shingles(x, n)
                n, m = max(1, min(5, len(dc.words(q)))), max(1, min(5, len(own)))
                if share(grams(dc.words(q), n), grams(passage, n)) >= 0.6 and share(dc.words(a), passage) >= 0.5 or share(grams(own, m), grams(passage, m)) >= 0.6:
                    want.add((doc, i))
    got = {(r.doc_id, r.item_id) for r in dc.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 20 < len(want) < 80


def test_licences_against_brute_force():
    """Every window of every width by plain sets: the best Dice of each template, and no find below the threshold."""
    from silvaspark.llm.licences import WIDTHS, Scanner, bigrams

    import math

    rng = random.Random(6)
    templates = [("A", text(rng, 12)), ("B", text(rng, 30)), ("C", text(rng, 60))]
    scanner = Scanner(templates, 0.9)
    for k in range(60):
        name, t = templates[k % 3]
        w = t.split(" ")
        for _ in range(k // 12):
            w.insert(rng.randrange(len(w)), "put" + str(rng.randrange(1000))) if k % 2 else w.pop(rng.randrange(len(w)))
        page = text(rng, 40) + " " + " ".join(w) + " " + text(rng, 40)
        b = bigrams(page).tolist()
        best = {}
        for n, body in templates:
            own, length = set(bigrams(body).tolist()), len(bigrams(body))
            best[n] = max(2 * len(own & set(b[j : j + v])) / (len(own) + len(set(b[j : j + v]))) for v in {math.ceil(length * x) for x in WIDTHS} for j in range(len(b)))
        found = scanner.scan(page)
        want = {n for n, d in best.items() if d >= 0.9}
        assert {f[0] for f in found} == want
        assert all(f[1] == pytest.approx(best[f[0]]) for f in found)


def test_many_licences_in_one_text_take_linear_time():
    from silvaspark.llm.licence_templates import families, texts
    from silvaspark.llm.licences import TEMPLATES, Scanner

    scanner = Scanner(TEMPLATES + families() + texts(), 0.9)
    took = []
    for n in (4000, 16000):
        page = "Released under the MIT License. some words between them here. " * n
        began = time.process_time()
        found = scanner.scan(page)
        took.append(time.process_time() - began)
        assert len(found) == n and {f[0] for f in found} == {"MIT"}
    assert took[1] < 8 * took[0] + 1


def test_columns_with_the_names_that_operators_use(docs):
    from silvaspark.llm.mixing import mixed
    from silvaspark.llm.parity_join import one_of_each

    rng = random.Random(7)
    same = text(rng, 40)
    df = docs([(1, same), (2, same), (3, text(rng, 40)), (None, same), (4, None), (4, "")])
    for name in ("gone", "c", "root", "lead", "token", "g", "band", "pass1", "o", "s", "full", "cut_source", "target"):
        df = df.withColumn(name, F.lit(1))
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "3", "4", "4", "None"]
    assert mixed(df).columns == df.columns and mixed(df).count() > 0


def test_support_vectors_against_plain_coordinate_descent():
    """The same model with whole rows of scaled values and a weight a feature."""
    from silvaspark.llm.quality import BITS, fit, grams

    rng = random.Random(8)
    flags = np.zeros(1 << BITS, bool)
    texts = [text(rng, 12).encode() for _ in range(40)] + [re.sub("a", "#", text(rng, 12)).encode() for _ in range(30)]
    rows, y = [grams(t, flags).astype("<u4") for t in texts], np.array([1] * 40 + [0] * 30)
    model = fit(rows, y)
    counts = np.ones((2, 1 << BITS))
    for f, label in zip(rows, y, strict=True):
        counts[label, f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((70, 1 << BITS), np.float32)
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
    w, alpha, order = np.zeros((1 << BITS) + 1), np.zeros(70), np.random.default_rng(7)
    both, sign = np.hstack([x, np.ones((70, 1))]), np.where(y > 0, 1, -1)
    for _ in range(20):
        for i in order.permutation(70):
            new = min(max(alpha[i] - (sign[i] * (both[i] @ w) - 1) / (both[i] @ both[i]), 0), 1.0)
            w += (new - alpha[i]) * sign[i] * both[i]
            alpha[i] = new
    margins = np.array([model.margin(f) for f in rows])
    assert np.allclose(margins, x @ w[:-1], atol=1e-3)
    assert [model.score(f) >= 0.5 for f in rows] == [bool(v) for v in y]


def test_ranks_of_words_are_sorted_as_numbers(docs):
    """Arrays that may hold nulls are sorted as objects, which takes longer."""
    from silvaspark.llm.line_dedup import _groups

    groups = _groups(docs([(1, "one two three"), (2, None), (3, "three two one")]), 80, 100)
    assert not groups.schema["prefix"].dataType.containsNull
    assert [(r.n, r.prefix == sorted(r.prefix)) for r in groups.collect()] == [(3, True)]


def test_training_gathers_nothing_on_the_driver(spark, docs, monkeypatch):
    """The model is fitted by a task of an executor, to the same rows in the same order as by ``fit`` alone."""
    from pyspark.sql.classic.dataframe import DataFrame

    from silvaspark.llm import quality

    rng = random.Random(9)
    texts = {i: text(rng, 12) if i % 3 else text(rng, 12).replace("a", "#") for i in range(90)}
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in texts], "doc_id long, quality int")
    rows = docs(list(texts.items())).repartition(5)
    trained = sorted(r.doc_id for r in labels.where(~quality.held_out(F.col("doc_id"))).collect())
    flags = np.zeros(1 << quality.BITS, bool)
    want = quality.fit([quality.grams(texts[i].encode(), flags).astype("<u4") for i in trained], np.array([int(i % 3 > 0) for i in trained]))

    driver, fit = os.getpid(), quality.fit

    def elsewhere(*rows):
        assert os.getpid() != driver, "fitted on the driver"
        return fit(*rows)

    def gathered(_):
        raise AssertionError("gathered on the driver")

    with monkeypatch.context() as m:
        m.setattr(quality, "fit", elsewhere)
        m.setattr(DataFrame, "toArrow", gathered)
        got = quality.train(rows, labels)
    assert np.array_equal(got.weight, want.weight) and np.array_equal(got.square, want.square)
    assert (got.slope, got.shift) == (want.slope, want.shift)


def test_stages_on_nothing_and_on_nulls(spark, docs, tmp_path):
    """Every stage of the pipeline takes an empty table, and rows of nulls and empty texts, without losing what it keeps."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is this thing called. a spade.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty, odd = docs([]), docs([(None, None, None), (None, "", "s"), (1, "some words", "s"), (2, None, "s"), (2, "  ", None)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
        out = stage(spark, odd, str(tmp_path))
        assert out.count() <= 10, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns


def test_stored_tables_move_small_batches_and_write_few_files(spark):
    import pyarrow as pa

    from silvaspark.llm.common import stored
    from silvaspark.llm.components import components

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    wide = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("x"))
    assert stored(wide.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0] < 8 << 20
    before, aqe = (spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        roots = components(spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 3).alias("b")))
        files = len(roots.inputFiles())
        assert {r.node: r.root for r in roots.collect()} == {i: i - i % 3 if i >= 3 else 0 for i in range(300)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert files <= 8


def test_lines_of_unlike_size_and_order_meet(spark, docs):
    """Sets at the bound of 4 to 5, the larger one first or last, and sets of one size, in sizes on both sides of the sketches' steps."""
    from silvaspark.llm.line_dedup import dedup_lines

    rng = random.Random(12)
    lines = []
    for n in (4, 5, 8, 40, 64, 65, 80, 192, 240):
        for k in (n * 5 // 4, n * 5 // 4 + 1, n):
            words = ["v" + str(rng.randrange(10**9)) for _ in range(k)]
            other = words[:n] if k > n else [*words[: n - 1], "other"]
            pair = [words, rng.sample(other, len(other))]
            lines += [" ".join(w) for w in (pair if rng.random() < 0.5 else pair[::-1])]
    rows = list(enumerate(lines))
    want, seen = {}, []
    for i, line in rows:
        s = frozenset(line.split())
        want[i] = int(not any(100 * len(s & o) >= 80 * len(s | o) for o in seen))
        seen.append(s)
    assert 0 < sum(want.values()) < len(want)
    assert {r.doc_id: r.n_kept for r in dedup_lines(docs(rows)).collect()} == want


def test_lines_are_cut_once_and_few_rows_are_written(spark, docs, monkeypatch):
    """No filter cuts lines into words a second time, and no table of prefix tokens is stored between the two steps."""
    from silvaspark.llm import line_dedup

    rng = random.Random(13)
    vocabulary = ["w" + str(i) for i in range(400)]
    df = docs([(i, " ".join(rng.sample(vocabulary, 40))) for i in range(60)])
    plan = line_dedup._groups(df, 80, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "split(" in x]

    written, stored = {}, line_dedup.stored

    def counted(rows, name):
        out = stored(rows, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    assert sum(r.n_kept for r in line_dedup.dedup_lines(df).collect()) == 60
    assert written["line-groups"] == 60 and max(written.values()) == 60


def test_lines_are_numbered_without_a_sort(spark, docs):
    """Unique, near doc_ids give the numbers themselves; repeated, null or far ones are sorted. The order is the same."""
    from silvaspark.llm.line_dedup import _groups, dedup_lines

    near = [(i, f"alpha{i} beta{i}\ngamma{i} delta{i}\n\nalpha{i - 1} beta{i - 1}") for i in (7, -3, 2**31, 12, -(2**30))]
    for more in ([], [(7, "one more")], [(None, "one more")], [(2**62, "one more"), (-(2**62), "first of all")]):
        groups = _groups(docs(near + more), 80, 100)
        assert ("rangepartitioning" in groups._jdf.queryExecution().executedPlan().toString()) == bool(more)
        rows = groups.orderBy("g").collect()
        places = [(r.doc_id is not None, r.doc_id or 0, r.h, r.line_no) for r in rows]
        assert len({r.g for r in rows}) == len(rows) and places == sorted(places)
    assert {r.doc_id: r.n_kept for r in dedup_lines(docs([(5, "a b c"), (-5, "c b a\na b c d e")])).collect()} == {5: 0, -5: 2}


def test_words_are_lower_cased_as_in_their_line(spark):
    """Cut first and lower-cased alone: the same words as of the lower-cased line, each once, final sigma and odd blanks included."""
    from silvaspark.llm.line_dedup import _words

    lines = ["ΟΔΟΣ ΣΑΣ Σ ΑΣ. ΑΣ'Β", "İx  a A\tÉé\x0bB\fb\rc ", "", " \t", "Straße STRASSE straße ǅ", "plain Plain"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    whole = F.array_distinct(F.transform(F.filter(F.split(F.lower("line"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = df.select("i", _words(F.col("line")).alias("got"), whole.alias("want")).collect()
    assert [sorted(r.got) for r in rows] == [sorted(r.want) for r in rows] and sum(len(r.got) for r in rows) > 10
    assert not df.select(_words(F.col("line")).alias("t")).schema["t"].dataType.containsNull


def test_texts_of_unlike_ids_are_not_hashed(docs):
    """Texts are hashed only where a doc_id repeats or is null, to tell its rows apart."""
    from silvaspark.llm.line_dedup import _groups

    rows = [(1, "one two"), (2, "three four\nfive six")]
    assert {r.h for r in _groups(docs(rows), 80, 100).collect()} == {0}
    for more in ((2, "seven eight"), (None, "seven eight")):
        assert len({r.h for r in _groups(docs([*rows, more]), 80, 100).collect()}) == 3


def test_sets_of_sizes_far_apart_do_not_meet(spark, monkeypatch):
    """A token of some hundred sets leads only to pairs of neighbouring bands of size, not to all pairs."""
    from silvaspark.llm import line_dedup

    token = (line_dedup.BANDED + 1 << 58) + 12345
    rows = [(i, n, 0, 0, 0, 0, [token]) for i, n in enumerate((5, 10, 12, 20, 40, 80, 80))]
    groups = spark.createDataFrame(rows, "g long, n int, s long, x long, y long, z long, prefix array<long>")
    monkeypatch.setattr(line_dedup, "_may_link", lambda num, den: F.lit(True))
    met = line_dedup._with_all(groups, spark.createDataFrame([], "g long"), 80, 100).collect()
    assert sorted((r.a, r.b) for r in met) == [(1, 2), (5, 6)]
