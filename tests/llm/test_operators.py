"""The training-data operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "re", "to", "mi", "sol", "un", "der") for b in ("", "la", "ne", "st", "x")]
SENTENCE = "one two three four five six seven eight nine ten"


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, k):
    w = t.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Rows with nulls, empty texts, repeats, copies and near copies, and one long text."""
    rng = random.Random(5)
    base = [text(rng, rng.choice([1, 2, 3, 8, 30, 80, 150])) for _ in range(60)]
    near = [edited(rng, rng.choice(base[:30]), rng.choice([1, 2, 4])) for _ in range(60)]
    hot = text(rng, 120)
    near += [edited(rng, hot, rng.choice([1, 2, 3, 5])) for _ in range(60)]
    texts = base + near + [rng.choice(base) for _ in range(30)] + [None, "", " \n\t ", hot + "\n" + hot, text(rng, 8000)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, base[0]), (3, base[3])]


def test_line_dedup(docs, corpus):
    from silvaspark.llm.line_dedup import dedup_lines

    rng = random.Random(1)
    rows = []
    for i in range(60):
        lines = [text(rng, rng.choice([1, 2, 5, 6, 9, 15])) for _ in range(rng.randrange(6))]
        lines += [edited(rng, rng.choice(WORDS) + " " + SENTENCE, rng.randrange(3)) for _ in range(2)] + ["", "Common line here"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "\n\n  \n")]
    got = {r.doc_id: r for r in dedup_lines(docs(rows)).collect()}
    seen = []
    for i, t in rows:
        keep = []
        for line in (t or "").split("\n") if t is not None else []:
            s = frozenset(x for x in re.split(r"[\x20\x09-\x0d]+", line.lower()) if x)
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                keep.append(line)
            if s:
                seen.append(s)
        assert got[i].text == ("\n".join(keep) if t is not None else None)
        assert got[i].n_lines == (len(t.split("\n")) if t is not None else 0) and got[i].n_kept == len(keep)
    assert dedup_lines(docs([])).collect() == []


def test_block_max_wand_is_exact():
    from silvaspark.llm.decontaminate import Index, words

    rng = random.Random(2)
    items = [(i, text(rng, rng.randrange(3, 60)), text(rng, 3)) for i in range(300)]
    ix = Index(items)
    for _ in range(60):
        w = words(text(rng, 60))
        place = ix.places(w)
        terms = [t for t in np.unique(place).tolist() if t < len(ix.terms)]
        for least in (0.02, 0.2, 0.4, 0.7):
            scores = collections.defaultdict(float)
            for t in terms:
                for i, s in zip(ix.items[t], ix.shares[t], strict=True):
                    scores[i] += s
            assert sorted(i for i, _ in ix.retrieve(terms, least)) == sorted(i for i, s in scores.items() if s >= least - 1e-9)
            if any(s >= least for s in scores.values()):
                assert ix.possible(place, 128, 64, least)


def test_decontamination(spark, docs):
    from silvaspark.llm.decontaminate import contamination, decontaminate

    rng = random.Random(3)
    fresh = lambda n: " ".join("w" + str(rng.randrange(10**5)) for _ in range(n))
    items = [(i, fresh(30) + ". " + fresh(4) + ".") for i in range(40)]
    bench = spark.createDataFrame([*items, (None, "x y z"), (50, None), (51, "")], "item_id long, text string")
    rows = [(i, fresh(300)) for i in range(30)] + [(100 + i, fresh(200) + " " + t + " " + fresh(150)) for i, t in items[:20]]
    rows += [(200, items[3][1].upper()), (201, items[5][1].replace(" ", "\n")), (202, None), (203, "")]
    found = {(r.doc_id, r.item_id) for r in contamination(docs(rows), bench).collect()}
    assert found == {(100 + i, i) for i in range(20)} | {(200, 3), (201, 5)}
    clean = decontaminate(docs(rows), bench)
    assert clean.columns == docs(rows).columns
    assert {r.doc_id for r in clean.collect()} == {*range(30), 202, 203}
    assert contamination(docs(rows), bench.limit(0)).count() == 0 and decontaminate(docs(rows), bench.limit(0)).count() == len(rows)


def test_token_counts(docs, corpus):
    from tokenizers import Tokenizer

    from silvaspark.llm.token_counts import Counter, count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["Don't STOP <|endoftext|>x", "ΣΑΣ é é ﬁ İ", "日本 12３", "a\x1cb\x85c　d", "'ll're<|startoftext|>", "aaaa" * 40, "퟿ 🎉👩‍👩‍👧"]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)]
    for r in count_tokens(docs([(i, t) for i, (_, t) in enumerate(rows)]), path, 100).collect():
        t = rows[r.doc_id][1] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(t.encode()), n > 100)
    c = Counter(path)
    for t in odd + [x or "" for _, x in corpus]:
        assert c.count(t, chunk=5) == c.count(t)
    assert count_tokens(docs([]), path).collect() == []


def test_html_text(spark):
    from silvaspark.llm.html_text import blocks, extract_text, trained, training_pages

    model, wrong, n = trained(), 0, 0
    for page in training_pages(80, seed=77):
        leaves = [b for b in blocks(page) if b.label >= 0]
        wrong += sum(a != b.label for a, b in zip(model.viterbi(leaves), leaves, strict=True))
        n += len(leaves)
    assert wrong <= 0.01 * n
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three,   four &lt;five&gt; six seven.</p></article><div class=comments><p>Nice post</p></div><form>Your name <input></form><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>broken <b")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert got[1].text == "A & B One two. Three, four <five> six seven." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and None in got
    assert extract_text(df.limit(0)).count() == 0


def test_viterbi_is_best_path():
    import itertools

    from silvaspark.llm.html_text import NAMES, Block, Field

    rng = np.random.default_rng(3)
    f = Field(rng.normal(size=(len(NAMES), 2)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        page = [Block("x", int(rng.integers(1, 1 << 20))) for _ in range(n)]
        score = lambda y: sum(f.emit(b.bits)[k] for b, k in zip(page, y, strict=True)) + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert score(f.viterbi(page)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=n))))


def test_quality(spark, docs):
    from silvaspark.llm.quality import classify, keep_good

    rng = random.Random(4)
    good = [(i, text(rng, rng.randrange(1, 80)).capitalize() + ".") for i in range(300)]
    bad = [(300 + i, " ".join(w + rng.choice(["###", "!!", "$$"]) for w in text(rng, rng.randrange(5, 60)).split())) for i in range(150)]
    rows = good + bad + [(900, None), (901, ""), (None, "some text"), (1, good[1][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs(rows), labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 450]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id < 300) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = keep_good(docs(rows), labels)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} >= {r.doc_id for r in got if r.predicted}
    assert {r.score for r in classify(docs(rows), labels.limit(0)).collect()} == {0.5}
    assert classify(docs([]), labels).collect() == []


@pytest.mark.parametrize("digest", ["sha256", "weak"])
def test_exact_dedup(spark, docs, corpus, tmp_path, digest):
    from silvaspark.llm import exact_dedup as ed

    weak = lambda t: F.substring(F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256), 1, 1)
    path = f"file://{tmp_path}/documents.parquet"
    docs(corpus).repartition(5).write.parquet(path)
    got = ed.exact_dedup(spark, path, *([weak] if digest == "weak" else []), files_per_batch=2).collect()
    assert len(got) == len(corpus)
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(-1 if i is None else i)
    want = collections.Counter((None if i is None else i, max(groups[t or ""]), len(groups[t or ""])) for i, t in corpus)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_nothing(spark, docs, tmp_path):
    from silvaspark.llm.exact_dedup import exact_dedup

    path = f"file://{tmp_path}/documents.parquet"
    docs([]).write.parquet(path)
    assert exact_dedup(spark, path).collect() == []


def components_by_force(rows, k, num):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = [i for i in sets if i is not None]
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return sets, find


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 70)])
def test_parity_join(docs, corpus, k, num):
    from silvaspark.llm.parity_join import near_duplicates

    sets, find = components_by_force(corpus, k, num)
    for r in near_duplicates(docs(corpus), k, num, 100).collect():
        if r.doc_id is not None:
            assert r.component_id == find(r.doc_id) and r.n_shingles in map(len, sets[r.doc_id])
    if k == 5:
        assert near_duplicates(docs([])).collect() == []


def test_parity_join_counts_every_link(docs, corpus):
    from silvaspark.llm.parity_join import near_duplicates, shingle_set

    of = {i: frozenset(shingle_set(t.encode(), 5).tolist()) for i, t in corpus if i is not None and t}
    texts = {s for s in of.values() if s}
    want = {s: sum(100 * len(s & o) >= 80 * len(s | o) for o in texts) - 1 for s in texts}
    assert max(want.values()) > 10
    rows = [r for r in near_duplicates(docs(corpus), every_link=True).collect() if r.doc_id is not None]
    got = {r.doc_id: r.n_links for r in rows}
    assert all(got[i] == want.get(s, 0) for i, s in of.items())
    assert {r.doc_id: r.component_id for r in near_duplicates(docs(corpus)).collect() if r.doc_id is not None} == {r.doc_id: r.component_id for r in rows}


def test_parity_bound():
    from silvaspark.llm.parity_join import Bands, U, fold_to, folded, keys

    rng = np.random.default_rng(1)
    bands = Bands(90, 100)
    for n in (10, 40, 300, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(U))
            d = bands.most(n, n) // 2
            b = np.unique(np.concatenate([a[d:], rng.integers(0, 2**63, d).astype(U)]))
            differ = len(np.setxor1d(a, b))
            assert np.intersect1d(keys(a, bands), keys(b, bands)).size > 0
            x, y = np.frombuffer(folded(a), U), np.frombuffer(folded(b), U)
            m = min(len(x), len(y))
            assert np.bitwise_count(fold_to(x, m) ^ fold_to(y, m)).sum() <= differ


def test_licences(docs):
    from silvaspark.llm.licences import TEMPLATES, bigrams, scan_licences

    rng = random.Random(8)
    rows = [(i, text(rng, 40) + "\n" + t.upper() + "\n" + text(rng, 30)) for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(100, text(rng, 500)), (101, None), (102, ""), (103, "license"), (104, "Released under the MIT License. " + text(rng, 9) + " Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in scan_licences(docs(rows)).collect()}
    for i, (name, t) in enumerate(TEMPLATES):
        assert got[i].licence == name and got[i].dice == 1.0
    assert all(got[i].licence is None and got[i].n_found == 0 for i in (100, 101, 102, 103))
    assert [f.licence for f in got[104].found] == ["MIT", "CC-BY-NC-4.0"]
    # every window of a template's length, by force
    own = {n: set(bigrams(t).tolist()) for n, t in TEMPLATES[:2]}
    for i, t in rows[:5]:
        b = bigrams(t).tolist()
        best = max(2 * len(s & set(b[j : j + len(s)])) / (len(s) + len(set(b[j : j + len(s)]))) for s in own.values() for j in range(len(b)))
        assert best < 0.9 or got[i].dice >= best


def test_decontamination_of_whole_items_in_shards(spark, docs, monkeypatch):
    """An item all of whose text but the last sentence is there is found; scores do not depend on the number of shards."""
    from silvaspark.llm import decontaminate as dc

    rng = random.Random(12)
    fresh = lambda i, n: " ".join(f"{rng.choice(WORDS)}{i}" if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(n))
    bodies = [fresh(i, rng.choice([20, 40, 60])) for i in range(30)]
    items = spark.createDataFrame([(i, f"{t}. Wordlast{i}.") for i, t in enumerate(bodies)], "item_id long, text string")
    d = docs([(i, text(rng, 60) + " " + t + " " + text(rng, 60)) for i, t in enumerate(bodies)] + [(100, text(rng, 200))])
    hits = lambda: sorted(map(tuple, dc.contamination(d, items).collect()))
    one = hits()
    assert {(h[0], h[1]) for h in one} >= {(i, i) for i in range(30)} and not any(h[0] == 100 for h in one)
    assert [r.doc_id for r in dc.decontaminate(d, items).collect()] == [100]
    monkeypatch.setattr(dc, "SHARD_WORDS", 250)
    many = hits()
    assert [(h[:2], h[3:]) for h in many] == [(h[:2], h[3:]) for h in one]
    assert np.allclose([h[2] for h in many], [h[2] for h in one])


def test_licence_siblings(docs):
    """Members of a licence family get their own name, those without a template none, and whole texts one find."""
    from silvaspark.llm.licence_templates import families, texts
    from silvaspark.llm.licences import TEMPLATES, scan_licences

    rng = random.Random(9)
    head = next(t for n, t in TEMPLATES if n == "GPL-3.0-or-later")
    cc = "This work is licensed under a Creative Commons {} {} International License."
    want = [
        (head, "GPL-3.0-or-later"),
        (head.replace("version 3", "version 2"), "GPL-2.0-or-later"),
        (head.replace("General", "Lesser General"), "LGPL-3.0-or-later"),
        (head.replace("General", "Affero General"), "AGPL-3.0-or-later"),
        (head.replace("version 3", "version 7"), None),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU General Public License, version 3 or later.", "GPL-3.0-or-later"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        (cc.format("Attribution-ShareAlike", "4.0"), "CC-BY-SA-4.0"),
        (cc.format("Attribution-NonCommercial", "4.0"), "CC-BY-NC-4.0"),
        (cc.format("Attribution", "4.0"), "CC-BY-4.0"),
        (cc.format("Attribution", "5.0"), None),
    ]
    want += [(t, n) for n, t in families()]
    want += [(re.sub("copyright holder", "Example Company", t), n) for n, t in families() if n == "BSD-3-Clause"]
    whole = [(" ".join(w for i, w in enumerate(t.split()) if i % 97), n) for n, t in texts()]  # nearly whole: a word in 97 is lost
    rows = [(i, text(rng, 20) + "\n" + t + "\n" + text(rng, 20)) for i, (t, _) in enumerate(want + whole)]
    got = {r.doc_id: r for r in scan_licences(docs(rows)).collect()}
    wrong = [(name, got[i].licence, t[:80]) for i, (t, name) in enumerate(want + whole) if got[i].licence != name]
    assert not wrong
    assert all(got[i].n_found == 1 for i in range(len(want), len(rows)))


def test_token_records(spark, docs, corpus):
    from tokenizers import Tokenizer

    from silvaspark.llm.common import fresh_path
    from silvaspark.llm.token_records import read_token_records, shuffled_records, write_token_records

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    odd = ["  two  blanks", "tab\tand\r\nline", "x<|endoftext|>y", "don't stop 123 !? é́", " no break", "\n lead", "日本 語", "tail "]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)]
    manifest = write_token_records(docs(rows), fresh_path(spark, "records"), path, 2)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = [tuple(r) for r in read_token_records(spark, manifest, with_ids=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    mixed = shuffled_records(spark, manifest, 5).collect()
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in mixed))) == sorted(map(repr, ((w[0], w[4]) for w in want)))
    assert [r.place for r in mixed] == sorted(r.place for r in mixed) and [r.doc_id for r in mixed] != [w[0] for w in want]
    assert read_token_records(spark, write_token_records(docs([]), fresh_path(spark, "records"), path, 2)).collect() == []


def test_broken_record_is_noticed(tmp_path):
    import io

    from silvaspark.llm.token_records import frame, read_frame

    data = bytearray(frame(7, np.array([1, 2, 3], "<u2").tobytes(), 2))
    assert read_frame(io.BytesIO(bytes(data)))[1].tolist() == [1, 2, 3]
    for at in (3, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="checksum"):
            read_frame(io.BytesIO(bytes(bad)))


def test_mixing(docs):
    from silvaspark.llm.mixing import mix, mixed

    rng = random.Random(6)
    rows = [(i, text(rng, rng.randrange(0, 60)), f"s{min(6, i % 9)}" if i % 11 else None) for i in range(500)]
    rows += [(600, None, "s1"), (601, "", "s1"), (None, "a b c", "s2"), (5, rows[5][1], "s5"), (700, text(rng, 3000), "z")]
    stream, per_doc = mix(docs(rows), block=64)
    got = per_doc.collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-6 and free:  # share, stop at twice the size, share what is over again
        total, over = sum(weight[s] for s in free), 0.0
        for s in sorted(free, key=str):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                over += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
        left = over
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert stream.agg(F.sum("words")).first()[0] == sum(taken.values())
    again = mix(docs(rows[::-1]), block=64)[1]
    assert collections.Counter((r.doc_id, r.taken) for r in again.collect()) == collections.Counter((r.doc_id, r.taken) for r in got)
    # the schedule keeps every source near its share all along
    slots = stream.groupBy("slot", "sid").agg(F.sum("words").alias("w")).orderBy("slot").collect()
    half = collections.Counter()
    for s in slots[: len(slots) // 2]:
        half[s.sid] += 1
    whole = collections.Counter(s.sid for s in slots)
    assert all(abs(half[s] - whole[s] / 2) <= 8 for s in whole)
    out = mixed(docs(rows))
    assert out.columns == docs(rows).columns
    copies = collections.Counter(r.doc_id for r in out.collect())
    assert all(copies[r.doc_id] == int(r.taken / r.size + 0.5) for r in got if r.size and r.doc_id not in (None, 5))
    assert mix(docs([]))[1].collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet")
    kept = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, d), "stage")
        assert kept.columns == source.columns, name
        assert kept.join(source, "doc_id", "left_anti").isEmpty()
    out = corpus_pipeline.run(spark, d).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in kept.collect())
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out[:-1])]).tolist()
