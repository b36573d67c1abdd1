"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns; brute force where SQL can't tell."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import chat, decontam, jaccard, langid, licenses, media, mixing, pii, quality, urlfilter
from folioscope.llm.common import ALNUM_WORDS, SPACE_WORDS, batch_words, prepare

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        body = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 7, 20, 60, 200]))]
        rows.append([i, " ".join(body)])
        if i % 4 == 0 and len(body) > 6:
            for k in range(rng.randrange(1, 4)):
                other = list(body)
                for _ in range(max(1, len(other) // 40)):
                    other[rng.randrange(len(other))] = "changed"
                rows.append([1000 + 10 * i + k, "\n".join(other)])
        if i % 5 == 0:
            rows.append([2000 + i, " ".join(body).upper()])
    return [*rows, [5000, None], [5001, ""], [5002, " \n"], [5003, "a a a a a a"], [5004, "a a a a a"], [None, "null id text here and more"]]


def components_by_force(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(x for x in sets if x is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_force(rows)


def test_jaccard_crowded_groups(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    rows = [[i, " ".join(common + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30))])] for i in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_force(rows)


def test_jaccard_empty_table(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_bounds_difference():
    rng = np.random.RandomState(0)
    for _ in range(50):
        a = np.unique(rng.randint(0, 2**62, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[20:], rng.randint(0, 2**62, 15).astype(np.uint64)]))
        x, y = (np.unpackbits(jaccard.filter_sketch(s, 512)).sum() for s in (a, b))
        d = np.unpackbits(jaccard.filter_sketch(a, 512) ^ jaccard.filter_sketch(b, 512)).sum()
        assert d <= len(np.setxor1d(a, b)) and x <= len(a) and y <= len(b)


def test_words_whole_and_in_pieces():
    texts = ["Hello the  World x", "", None, "éa b\tc d ", "A" * 50 + " b"] * 3
    whole = [h.tolist() for h in batch_words(pa.array(texts), SPACE_WORDS)]
    small = [h.tolist() for h in batch_words(pa.array(texts), SPACE_WORDS, piece=5)]
    assert whole == small and [len(h) for h in whole] == [len(words(t)) for t in texts]
    assert [len(h) for h in batch_words(pa.array(["a-b c9é"]), ALNUM_WORDS)] == [3]


def test_language_id(spark):
    en, de = "the house and the garden with that tree", "das haus und der garten mit dem baum"
    rows = [(i, f"{en} {i}" if i % 2 else f"{de} {i}", "en" if i % 2 else "de", "s", 1) for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, None, "en", None, None), (101, "", None, None, None), (102, "12 345 !!", None, None, None)], DOC)
    model = langid.fit(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs.withColumn("score", F.lit(5)), model).collect()}
    assert all(out[r[0]]["lang_pred"] == r[2] and 0.5 < out[r[0]]["score"] <= 1 for r in rows)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (100, 101, 102))
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    long = "ab, Zé " * 3000
    tables = langid.alphabet()
    whole = sorted(langid.grams([long], 12, tables).ids.tolist())
    assert all(sorted(np.concatenate(list(langid.buckets(long, 12, tables, piece))).tolist()) == whole for piece in (97, 1000, 1 << 20))


def test_mixing_properties(spark):
    rows = [(i, f"{'w ' * (i % 37)}", "en", ["a", "b", None, "c"][i % 4] if i % 3 else "hot", 0) for i in range(500)] + [(7, None, None, "a", 0), (7, "w w", None, "a", 0), (None, "w", None, "z", 0)]
    docs = spark.createDataFrame(rows, DOC)
    out = mixing.mix_documents(docs, block_tokens=64).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5 and g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    assert abs(out.drop_duplicates("source").target.sum() - 1.5 * out["size"].sum()) < 1e-6
    again = mixing.mix_documents(docs.repartition(7), block_tokens=64).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert out[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_url_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]
    rows = [(1, "HTTPS://A.Example.COM/en/71?x", None), (2, "http://b.com/en/#", "<a href='http://x.org/'>"), (3, None, ""), (4, "no scheme", None), (5, "http://xcom/en/", None), (6, "http://y.org", '<a href="http://b.com/">')]
    out = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert out[2]["verdict"] == "block" and out[5]["rule"] is None
    assert out[3]["host"] == out[4]["path"] == "" and out[3]["verdict"] == "allow"
    assert out[6]["verdict"] == "block"  # it links a blocked host


def levenshtein_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_url_distrust_of_a_tiny_share(spark):
    to = lambda host, n: f'<a href="http://{host}/">' * n
    rows = [(1, "http://bad.org/x", ""), (2, "http://big.net/", to("bad.org", 30000)), (3, "http://mid.net/", to("bad.org", 1)), (4, "http://wide.net/", to("mid.net", 30000)), (5, "http://far.net/", to("mid.net", 1)), (6, "http://none.net/", "")]
    out = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), [("block", "bad.org", "/")]).collect()}
    assert 0 < out[5]["distrust"] < 5e-10 and out[5]["trust"] == 0
    assert [out[k]["verdict"] for k in range(1, 7)] == ["block"] * 5 + ["allow"]


def test_decontamination(spark):
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25))
    noise = lambda: " ".join("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(60))
    edited = list(item)
    for k in (20, 70, 120):
        edited[k] = "z"
    rows = [(1, f"{noise()} {item.upper()} {noise()}"), (2, noise() + " " + "".join(edited)), (3, noise()), (4, None), (5, ""), (6, item[:60]), (1, f"{noise()}\n{item.replace(' ', ', ')}")]
    bench = spark.createDataFrame([(9, item), (10, None), (11, "short")], "item_id long, text string")
    out = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert out == [(1, 9, 0), (1, 9, 0), (2, 9, 3)]
    assert decontam.best_match(np.frombuffer(b"kitten", np.uint8), np.frombuffer(b"xx sitting yy", np.uint8))[0] == levenshtein_in("kitten", "xx sitting yy")
    assert decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_chat_round_trip(spark):
    prepare(spark)
    hard = ["\\### Assistant: </turn> ok", "", None, "a\\", "### x", "é\\\\#<:", "</turn>\n### user: "]
    rows = [(c, i, r, t) for c in (1, None) for i, (t, r) in enumerate(zip(hard, ["user", "assistant", "a:b#", "assistant", None, "assistant", "system"], strict=True))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    for size in (1 << 20, 10):
        got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(turns, part_chars=size)).collect()}
        mine = [r for r in rows if r[0] == 1]
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert got[1]["n_turns"] == 7 and got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[1]["turns_sha256"] == got[None]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine).encode()).hexdigest()


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "cc by CC-BY cc  by"), (5, "Licensed under the terms of the GNU General Public License, either version 3 of the License"), (6, "licensed under the apache license version 1")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x"))).collect()}
    assert out[1]["labels"] == "mit,mit-notice" and out[1]["first_word"] == 3 and out[1]["score"] == 1.0
    assert out[2]["n_words"] == out[3]["n_base"] == 0 and out[2]["first_word"] is None and out[3]["labels"] == ""
    assert out[4]["n_base"] == 3 and (out[4]["first_word"], out[4]["last_word"]) == (0, 4)
    assert out[5]["labels"] == "gpl,gpl-3.0" and out[6]["labels"] == "apache" and out[6]["score"] == 0.5


def picture(seed):
    rng = np.random.RandomState(seed)
    at = np.linspace(0, 7, 64)
    return media._sample(rng.rand(8, 8) * 255, at[:, None] + 0 * at, at + 0 * at[:, None])


def pgm(x):
    x = np.clip(np.round(x), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.tobytes()


def test_media_copies(spark):
    a, b = picture(1), picture(2)
    rows = [(1, pgm(a)), (2, pgm(a[4:60, 3:62] * 0.9 + 6)), (3, pgm(b)), (4, pgm(b)), (5, None), (6, b"junk"), (7, pgm(np.zeros((64, 64)))), (8, pgm(picture(3)))]
    out = {r["image_id"]: r["copy_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}


def test_media_family_links_through_stars(spark):
    rng = np.random.RandomState(4)
    a, b = picture(11), picture(12)
    rows = [(i, pgm((a if i % 2 else b) + rng.normal(0, 2, a.shape)), "x") for i in range(24)] + [(None, pgm(a), "x"), (24, None, None)]
    out = media.copies(spark.createDataFrame(rows, "image_id long, image binary, key string"))
    assert {r["image_id"]: r["copy_id"] for r in out.where("image_id is not null").collect()} == {i: i % 2 if i < 24 else i for i in range(25)}
    assert out.where("image_id is null").count() == 1
    assert media.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_media_family_costs_its_length(spark, monkeypatch):
    tried, confirmed = [], media._confirmed
    monkeypatch.setattr(media, "_confirmed", lambda pairs, *rest: tried.append(pairs.count()) or confirmed(pairs, *rest))
    rng = np.random.RandomState(4)
    a = picture(11)
    rows = [(i, pgm(a + rng.normal(0, 2, a.shape))) for i in range(60)] + [(99, pgm(picture(12)))]
    out = {r["image_id"]: r["copy_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert out == {**{i: 0 for i in range(60)}, 99: 99}
    assert sum(tried) < 180  # of 1770 pairs


def test_media_family_leaves_its_entries(spark, monkeypatch):
    held, keep = [], media.Stages.keep

    def counted(self, df):
        out = keep(self, df)
        if {"entry", "rep"} <= set(out.columns):
            held.append(out.count())
        return out

    monkeypatch.setattr(media.Stages, "keep", counted)
    rng = np.random.RandomState(4)
    a = picture(11)
    rows = [(i, pgm(a + rng.normal(0, 2, a.shape))) for i in range(60)] + [(99, pgm(picture(12)))]
    out = {r["image_id"]: r["copy_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert out == {**{i: 0 for i in range(60)}, 99: 99}
    assert sum(held) < 60 * 20  # one group of classes shares no entry with another


def texture(seed, side=160):
    at = np.linspace(0, side // 8 - 0.001, side)
    return media._sample(np.random.RandomState(seed).rand(side // 8 + 1, side // 8 + 1) * 255, at[:, None] + 0 * at, at + 0 * at[:, None])


def test_media_crops_of_large_pictures(spark):
    a, b = texture(1, 320), texture(2, 320)
    rows = [(1, pgm(a)), (2, pgm(b)), (3, pgm(a[100:180, 60:140])), (4, pgm(b[200:280, 150:230])), (5, pgm(texture(3)))]
    out = {r["image_id"]: r["copy_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_media_turned_and_resized(spark):
    a, b = texture(1), texture(2)
    rows = [(1, pgm(a)), (2, pgm(b)), (3, pgm(np.rot90(a))), (4, pgm(media._shrink(b, 1.25))), (5, pgm(texture(3)))]
    out = {r["image_id"]: r["copy_id"] for r in media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_pii_round_trip(spark):
    key = b"k"
    text = "call +1 (743) 555-3824 or und.34@mail7.example.com card 4111111111111111 not 9807915762804490 at 227.5.221.1 999.1.1.1 on 2024-02-29, 31/02/2020, 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" v2.0."
    new, spans = pii.mask(text, key)
    assert pii.mask(new, key, back=True)[0] == text and "9807915762804490" in new and "999.1.1.1" in new and "31/02/2020" in new
    for gone in ("555-3824", "und.34", "4111111111111111", "227.5.221.1", "2024-02-29", "123-45-6789", "04dbebab"):
        assert gone not in new
    assert {k for k, *_ in spans} == {"phone", "email", "card", "ip", "date", "ssn", "key"}
    card = re.search(r"card (\d{16})", new)[1]
    assert pii.luhn(card)
    out = pii.pseudonymise(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x 4111111111111111 y")], "doc_id long, text string").withColumn("pii", F.lit(0)), key).orderBy("doc_id").collect()
    assert out[0]["text"] == new and out[1]["text"] is None and out[2]["text"] == "" and card in out[3]["text"]
    assert len({pii.permute(v, 10, 13, key, "t") for v in range(130)}) == 130


def test_pii_address_without_digits(spark):
    text = "write to anna@example.org for details"
    out = pii.pseudonymise(spark.createDataFrame([(1, text), (2, "no mark at all")], "doc_id long, text string"), b"k").orderBy("doc_id").collect()
    new, spans = pii.mask(text, b"k")
    assert "anna@" not in out[0]["text"] and out[0]["text"] == new and [tuple(x) for x in out[0]["pii"]] == spans == [("email", 9, 25)]
    assert out[1]["text"] == "no mark at all" and out[1]["pii"] == []


def test_quality(spark):
    rows = [(i, ("some plain words of a text that reads well. " * 5) if i % 3 else ("bad### words$$$ | x!! | " * 9)) for i in range(90)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, usable=F.col("doc_id") % 5 != 0)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((out[i] >= 0.3) == (i % 3 > 0) for i in range(90)) and all(0 <= s <= 1 for s in out.values()) and len(out) == 92
    assert quality.fit(docs, labels.limit(0), usable=F.lit(True))["at"] == 0.0


def test_quality_learns_from_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Plain", "words", "of", "text.", "###", "$x|", "77", "so,", "\n"]) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    known = {i: int(t.count("#") + t.count("$") + rng.randrange(6) < 8) for i, t in rows if i % 7}
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    model = quality.fit(docs.repartition(3), labels, usable=F.lit(True))
    x, y = quality.batch_features(pa.array([t for i, t in rows if i in known])), np.array(list(known.values()))
    assert np.allclose(model["mean"], x.mean(0)) and np.allclose(model["scale"], x.std(0) + 1e-3)
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ (1 - p) / len(d) - 1e-3 * w)
    assert np.abs(model["w"] - w).max() < 1e-6
    s = z @ w
    assert abs(model["at"] - np.quantile(s, (y == 0).mean())) < 1e-5 and abs(model["spread"] - s.std()) < 1e-5


def test_components_of_a_path(spark):
    from folioscope.llm.common import Stages
    from folioscope.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    with Stages(spark) as stages:
        got = {r["node"]: r["comp"] for r in components(edges, stages).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_tiny(spark, tmp_path, n):
    import corpus_pipeline

    spark.createDataFrame([(1, "the words of one text", "en", "s", 21)][:n], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of that kind is in here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == n


def test_language_against_brute_force(spark):
    """Naive Bayes over n-grams of single texts, in plain Python."""
    import math
    import unicodedata
    from collections import Counter

    rng = random.Random(4)
    heads = {"aa": "abcde ", "bb": "cdefg ", "cc": "xyzab "}
    rows = [(i, "".join(rng.choice(heads[lang]) for _ in range(rng.randrange(0, 40))) + rng.choice(["", " 12", "É!", "\n"]), lang) for i, lang in enumerate(list(heads) * 12)]
    rows += [rows[3], (90, None, "aa"), (91, "", "bb"), (92, "123 ?", "cc"), (93, "abc", None), (94, "\u0301", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits = 13

    def own(text):
        flat = " " + "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text) + " "
        flat = re.sub(" +", " ", flat)
        for k in (1, 2, 3):
            for i in range(len(flat) - k + 1):
                h = 0
                for c in flat[i : i + k]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                yield (h + k) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - bits)

    count = {x: Counter() for x in heads}
    for _, t, x in rows:
        if x and t is not None:
            count[x].update(own(t))
    model = langid.fit(docs, bits=bits)
    for r in langid.identify(docs, model).collect():
        text = r["text"]
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        scores = {x: sum(math.log(count[x][b] + 0.5) - math.log(sum(count[x].values()) + 0.5 * 2**bits) for b in own(text)) for x in heads}
        best = max(sorted(scores), key=scores.get)
        assert r["lang_pred"] == best or abs(scores[r["lang_pred"]] - scores[best]) < 1e-9
        assert abs(r["score"] - 1 / sum(math.exp(v - scores[best]) for v in scores.values())) < 1e-9


def test_pii_against_an_ungated_mask(spark):
    rows = [(1, "please write to bob.smith@example.com for details"), (2, "on 2001-03-04, 04/03/2001 and 03/25/2001 or 2001-03-25"), (3, "+1 743-555-3824 or (743) 555-3824"), (4, "\u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669 123-45-6789"), (4, None), (5, ""), (6, "nothing"), (6, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = b"k"
    got = {(r["doc_id"], r["text"], tuple(map(tuple, r["pii"] or ()))) for r in pii.pseudonymise(docs, key).collect()}
    assert got == {(i, *((None, ()) if t is None else (pii.mask(t, key)[0], tuple(pii.mask(t, key)[1])))) for i, t in rows}
    for _, t in rows[:4]:
        assert pii.mask(pii.mask(t, key)[0], key, back=True)[0] == t
    dates = re.findall(r"[0-9-]{10}|[0-9/]{10}", pii.mask(rows[1][1], key)[0])
    y, m, d = dates[0].split("-")
    assert dates[1] == f"{d}/{m}/{y}" and dates[0] != "2001-03-04"
    y, m, d = dates[3].split("-")
    assert dates[2] == f"{m}/{d}/{y}"
    phones = re.findall(r"743|[0-9]{3}[ )-]+[0-9]{3}-[0-9]{4}", pii.mask(rows[2][1], key)[0])
    assert len({re.sub("[^0-9]", "", p) for p in phones}) == 1
    assert pii.mask(rows[3][1], key)[0].startswith(rows[3][1][:11]) and len(pii.mask(rows[3][1], key)[1]) == 1
    empty = pii.pseudonymise(docs.limit(0), key)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "pii"]


def test_digest_of_stored_parts_in_any_order(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c} " * 5) for c in range(5) for t in range(8)]
    parts = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_chars=200).cache()
    want = sorted(map(tuple, chat.digest(parts).collect()))
    assert parts.count() > 5 and sorted(map(tuple, chat.digest(parts.orderBy(F.desc("part"))).collect())) == want
    assert chat.digest(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.parametrize("n_words", [20, 40, 80])
def test_decontamination_reaches_its_recall(n_words):
    """200 items a length with as many random edits as are allowed, found by the index itself."""
    rng, np_rng = random.Random(n_words), np.random.RandomState(1)
    items = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(n_words))) for i in range(200)]
    index = decontam.build(items, 0.06, 0.97, 8, 6)
    found = 0
    for i, text in items:
        x = decontam.normal(text)
        y = decontam.edited(x, decontam.allowed_edits(len(x), 0.06) * 9 // 10, np_rng)
        doc = np.concatenate([decontam.normal("some words before it "), [np.uint32(32)], y, [np.uint32(32)], decontam.normal("and after")]).astype(np.uint32)
        found += any(index.ids[k] == i for _, k, _, _ in decontam._search(doc, np.array([0, len(doc)]), index))
    assert found >= 180


def test_decontamination_takes_little_memory():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(40)]
    index = decontam.build(items, 0.06, 0.97, 8, 6)
    text = " ".join(rng.choice(vocab) if i % 7000 else items[i // 7000][1] for i in range(7000, 260_000))
    x = decontam.normal(text)
    assert len(x) > 1_500_000
    whole = index.bitmap[decontam._slot(decontam.q_hashes(x))]
    tracemalloc.start()
    found = list(decontam._search(x, np.array([0, len(x)]), index))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {index.ids[i] for _, i, _, _ in found} == set(range(1, 38)) and all(edits == 0 for _, _, edits, _ in found)
    assert most < 24 * len(x)  # bytes a code; hashes of all places at once take 35
    assert (decontam._marks(x, index.bitmap) == whole).all() and not len(decontam._marks(x[:5], index.bitmap))


def test_batches_have_few_bytes(spark):
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(24, numPartitions=1).select(F.repeat(F.lit("some words "), 100_000).alias("text"))
    sent = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(sent) > 24 * 1_100_000 and max(sent) < 7_000_000


def test_decontamination_of_clashing_names_and_repeats(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(1, "x " + item + " y"), (1, "x " + item + " y"), (2, None), (3, ""), (4, "z" * 3000 + " " + item)], "edits long, text string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    got = decontam.find(docs, bench, id_col="edits")
    assert got.columns == ["id_edits", "item_id", "edits", "item_chars", "end_char"]
    assert sorted((r["id_edits"], r["item_id"], r["edits"]) for r in got.collect()) == [(1, 7, 0)] * 4 + [(4, 7, 0)] * 2


def test_schedule_keeps_every_stretch_in_proportion(spark, monkeypatch):
    goals = spark.createDataFrame([("a", 600_000, 500_000.0), ("b", 300_000, 300_000.0), (None, 200_000, 200_000.0)], "source string, source_size long, target double")
    order = [r["source"] for r in mixing.schedule(goals, 500).orderBy("slot").collect()]
    assert len(order) == 500
    for name, share in (("a", 0.5), ("b", 0.3), (None, 0.2)):
        seen = 0
        for n, x in enumerate(order, 1):
            seen += x == name
            assert abs(seen - share * n) < 4
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * 900) for i in range(60)], "doc_id long, source string, text string")
    first = {r["doc_id"]: r["first_slot"] for r in mixing.mix_documents(docs).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 0.7548776662466927)
    assert {r["doc_id"]: r["first_slot"] for r in mixing.mix_documents(docs).collect()} != first


def test_stage_near_duplicates_by_force(spark):
    """What stays of copies, near copies, repeated ids and rows without an id."""
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(60))
    near, far = base.replace("w30", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (2, near), (3, base.upper()), (4, far), (4, far), (5, None), (6, ""), (None, base), (None, "only here without an id at all"), (None, "only here without an id at all"), (None, None), (7, "short text")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted([("1", base), ("4", far), ("5", "None"), ("6", ""), ("None", "only here without an id at all"), ("None", "None"), ("7", "short text")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
