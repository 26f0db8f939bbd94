"""URL filter, quality classifier and personal data against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.llm import ordinal, pii, urls
from driftgate.llm.queries import all_queries

SMALL = "/root/testdata/sf0.001"


# -- URLs


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


class PlainModel:
    """The two models with exact contexts instead of hashed ones."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            for context, c in self.steps(t):
                for k in range(urls.ORDER + 1):
                    own = context[len(context) - k :]
                    self.n[k, own, c] = self.n.get((k, own, c), 0) + 1
                    self.n[k, own, None] = self.n.get((k, own, None), 0) + 1

    @staticmethod
    def steps(text):
        s = [257] * urls.ORDER + list((text or "").encode()) + [256]
        return [(tuple(s[i - urls.ORDER : i]), s[i]) for i in range(urls.ORDER, len(s))]

    def mean_log(self, text):
        total = 0.0
        for context, c in self.steps(text):
            p = 1 / 257
            for k in range(urls.ORDER + 1):
                own = context[len(context) - k :]
                p = (self.n.get((k, own, c), 0) + urls.STRENGTH * p) / (self.n.get((k, own, None), 0) + urls.STRENGTH)
            total += math.log(p)
        return total / len(self.steps(text))


def test_url_rules_and_scores(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    rows = pages.withColumn("fold", F.pmod(F.xxhash64("url"), urls.FOLDS)).collect()
    sides = {"allow": [], "block": []}
    for r in rows:
        hit = plain_rule(r.url)[2]
        if hit and r.fold:
            sides[hit[1]].append(r.url)
    yes, no = PlainModel(sides["allow"]), PlainModel(sides["block"])
    table, threshold = urls.train(pages)
    got = {r.page_id: r for r in all_queries()["op4_url_filter"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    off = [got[r.page_id].score - (yes.mean_log(r.url) - no.mean_log(r.url)) for r in rows]
    assert np.median(np.abs(off)) < 1e-6 and np.max(np.abs(off)) < 0.2  # a context rarely shares all its slots
    for r in rows:
        host, path, hit = plain_rule(r.url)
        mine = got[r.page_id]
        want = hit[1] if hit else "allow" if mine.score >= threshold else "block"
        assert (mine.host, mine.path, mine.rule, mine.verdict) == (host, path, hit and hit[0], want)
    # held out: the models tell the two sides apart
    held = [(plain_rule(r.url)[2][1], got[r.page_id].score) for r in rows if plain_rule(r.url)[2] and not r.fold]
    assert np.mean([(s >= threshold) == (v == "allow") for v, s in held]) > 0.8


def test_url_cases(spark):
    odd = [
        None, "", "no scheme", "://", "http://", "HTTP://COM/", "x://A.COM?x", "x://com", "ftp://sub.Example.COM/en/#a",
        "http://www.example.com/en/x", "http://b.www.example.com/en/", "http://xexample.com/en/", "http://a.net/es/",
        "http://net/fr/?q", "http://example.net/FR/", "http://ÉA.com/", "a://b://c.com/", "http://a.com:80/", "http://" + "a" * 50_000,
    ]
    rows = [(i, u, "clash") for i, u in enumerate(odd)] + [(3, odd[3], "clash")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, score string")
    out = urls.judge(df).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, hit = plain_rule(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, hit and hit[0])
        assert r.verdict == hit[1] if hit else r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    unruled = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(unruled).collect()] == ["allow"]


def test_url_keys_are_not_broadcast(spark, monkeypatch):
    """Keys look smaller to Spark than they are: a few MB of URLs on disk ask for gigabytes of them."""
    plans, scored = [], urls.scored

    def watched(*args):
        out = scored(*args)
        out.count()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(urls, "scored", watched)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower() not in ("-1", "0")
    rows = [(i, f"http://{'a.com' if i % 2 else 'b.net'}/{'' if i % 2 else 'es/'}{i}") for i in range(300)]
    assert len(urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()) == 300
    assert len(plans) == 2  # the held-out URLs and all
    for plan in plans:
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


# -- quality


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), 5) == 0
    model = ordinal.train(docs, labels.filter(~held))
    out = ordinal.score(docs.select("doc_id", "text"), model).join(ordinal.graded(labels.filter(held)), "doc_id")
    share = {r.grade: r for r in out.groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("mean")).collect()}
    assert share[2].kept > 0.98 and share[1].kept < 0.25 and share[0].kept < 0.1
    assert share[0].mean < share[1].mean < share[2].mean
    assert (np.diff(model.cuts) >= 0).all()


def test_quality_cases(spark):
    texts = [None, "", "good words here " * 3, "bad words", "é" * 10, "word " * 100_000]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(2, texts[2], 1.0)], "doc_id bigint, text string, level double")
    labels = spark.createDataFrame(
        [(2, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (99, 1, 0), (4, None, None), (5, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    assert {r.doc_id: r.grade for r in ordinal.graded(labels).collect()} == {2: 2, 3: 1, 99: 2, 5: 0}
    out = ordinal.score(docs, ordinal.train(docs, labels)).collect()
    assert len(out) == 7
    for r in out:
        assert 0 <= r.p_good <= r.p_safe <= 1 and r.expected_grade == pytest.approx(r.p_good + r.p_safe)
    untrained = ordinal.score(docs, ordinal.train(docs, labels.limit(0)))
    assert untrained.filter("keep").count() == 7
    assert ordinal.score(docs.limit(0), None).count() == 0


# -- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_find(t):
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = [int(x) for x in re.sub("[^0-9]", "", m.group())][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((*m.span(), "card"))
    return out + [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_plain_spans_equal_patterns():
    rng = random.Random(1)
    parts = ["@", ".", "a", "B", "1", "2", "9", "255", "300", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "+1 ", "é"]
    for _ in range(20_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert pii.find(s) == plain_find(s)
    for s in ("a" * 1000 + "@b.c", "x@y.z" * 300, "1" * 9000 + ".1.1.1", "a" * 300_000, "1" * 300_000, "+" * 100_000):
        assert pii.find(s) == (plain_find(s) if len(s) < 5000 else [])


@pytest.mark.parametrize(
    ("text", "found", "kind"),
    [
        ("mail john.doe [at] example [dot] com now", "john.doe [at] example [dot] com", "email"),
        ("so john at example dot com, yes", "john at example dot com", "email"),
        ("ｊohn＠exаmple.com", "ｊohn＠exаmple.com", "email"),
        ("x jo​hn@ex​ample.com", "jo​hn@ex​ample.com", "email"),
        ("call plus one five five five two three six seven eight nine zero ok", None, "phone"),
        ("four one one one one one one one one one one one one one one one", "four" + " one" * 15, "card"),
        ("ip one nine two dot one six eight dot zero dot one.", "one nine two dot one six eight dot zero dot one", "ip"),
        ("٤١١١ ١١١١ ١١١١ ١١١١", "٤١١١ ١١١١ ١١١١ ١١١١", "card"),
    ],
)
def test_disguises(text, found, kind):
    base, spans = pii.find_all(text)
    found = found or text[len("call ") : -len(" ok")]
    assert (text.index(found), text.index(found) + len(found), kind) in spans
    assert set(base) <= set(spans)


@pytest.mark.parametrize(
    "text, masked",
    [
        ("+1 555 123 456 seven eight nine zero", "[phone]"),
        ("john [dot] smith@example.com", "[email]"),
        ("call +1 five five five 123 4567 now", "call [phone] now"),
        ("mail\tjohn\tat\texample\tdot\tcom", "mail\t[email]"),
    ],
)
def test_disguises_beside_plain_ones(text, masked):
    assert pii.mask(text, pii.find_all(text)[1]) == masked


def test_plain_number_before_a_word():
    for text in ("call 555-123-4567 two times", "one of 192.168.10.12", "chapter one 12"):
        assert pii.find_all(text)[1] == pii.find_all(text)[0]


def test_no_false_disguises():
    for text in ("see you at noon dot", "one two three go", "at example.com", "three of one and four", "1 2 3 4", ""):
        assert pii.find_all(text) == ([], [])


def test_annotate(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rank = {k: i for i, k in enumerate(pii.KINDS)}
    for r in all_queries()["op6_personal_data"](spark, SMALL).collect():
        want = sorted(plain_find(texts[r.doc_id]), key=lambda x: (x[0], rank[x[2]]))
        spelled = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(filter(None, r.spans.split(",")))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(list(filter(None, r.spans.split(","))))


def test_annotate_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.c and a [at] b.c", "x"), (3, "a@b.c and a [at] b.c", "x"), (None, "no", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = pii.annotate(df, masked=True)
    got = sorted(((r.doc_id or 0, r.text, r.n_email, r.spans) for r in out.collect()), key=str)
    hit = (3, "[email] and [email]", 2, "email:0:5,email:10:20")
    assert got == sorted([(1, None, 0, ""), (2, "", 0, ""), hit, hit, (0, "no", 0, "")], key=str)
    assert pii.annotate(df.limit(0)).count() == 0


# -- the classifier's query against plain loops


def plain_fit(texts, grades, seed=3):
    """The cumulative-link fit, one text, one slot and one threshold at a time."""
    import pyarrow as pa

    # numpy's exponential: the last bit decides whether slopes cancel, and a slot without a slope is not shrunk
    sigmoid = lambda x: float(1 / (1 + np.exp(np.clip(np.array([-x]), -500, 500)))[0])
    slots = [ordinal.features(pa.array([t]))[0].tolist() for t in texts]
    share = [(sum(g <= j for g in grades) + j + 1) / (len(grades) + ordinal.GRADES) for j in range(ordinal.GRADES - 1)]
    cuts, cut_seen = [math.log(s / (1 - s)) for s in share], [1e-6] * (ordinal.GRADES - 1)
    weights, seen = {}, {}
    rng = np.random.default_rng(seed)
    for _ in range(ordinal.EPOCHS):
        order = rng.permutation(len(texts)).tolist()
        for at in range(0, len(order), ordinal.BATCH):
            rows = order[at : at + ordinal.BATCH]
            grad, g = {}, [0.0] * len(cuts)
            edge = [-math.inf, *cuts, math.inf]
            for i in rows:
                level, y = sum(weights.get(s, 0.0) for s in slots[i]), grades[i]
                high, low = sigmoid(edge[y + 1] - level), sigmoid(edge[y] - level)
                p = max(high - low, 1e-9)
                up, down = high * (1 - high) / p, low * (1 - low) / p
                for s in slots[i]:
                    grad[s] = grad.get(s, 0.0) + (up - down) / len(rows)
                if y < ordinal.GRADES - 1:
                    g[y] -= up / len(rows)
                if y > 0:
                    g[y - 1] += down / len(rows)
            for s, d in grad.items():
                if d == 0:
                    continue
                seen[s] = seen.get(s, 1e-6) + d * d
                step = ordinal.RATE / math.sqrt(seen[s])
                moved = weights.get(s, 0.0) - step * d
                weights[s] = math.copysign(max(abs(moved) - step * ordinal.L1, 0.0), moved)
            for j, d in enumerate(g):
                cut_seen[j] += d * d
                cuts[j] -= ordinal.RATE * d / math.sqrt(cut_seen[j])
            for j in range(1, len(cuts)):
                cuts[j] = max(cuts[j] + j * 1e-9, cuts[j - 1])
    return weights, cuts


def test_quality_query_equals_plain_loops(spark):
    import pyarrow as pa

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    grades = {r.doc_id: r.grade for r in ordinal.graded(spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    known = sorted(set(docs) & set(grades))
    weights, cuts = plain_fit([docs[i] for i in known], [grades[i] for i in known])
    out = all_queries()["op5_quality"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        level = sum(weights.get(s, 0.0) for s in ordinal.features(pa.array([docs[r.doc_id]]))[0].tolist())
        tails = [1 / (1 + math.exp(c - level)) for c in cuts]
        assert r.level == pytest.approx(level, abs=1e-4)
        assert (r.p_safe, r.p_good, r.expected_grade) == pytest.approx((*tails, sum(tails)), abs=1e-4)
        assert abs(r.p_good - ordinal.KEEP) < 1e-4 or r.keep == (tails[1] >= ordinal.KEEP)


def test_overfull_orders_take_no_part(monkeypatch):
    """Far more contexts than cells: without the rule collisions drown what short contexts tell."""
    import pyarrow as pa

    monkeypatch.setattr(urls, "SLOTS", 2048)
    rng = random.Random(8)

    def url(good):
        # the sides differ in pairs of letters; everything longer is noise
        letters, out = "abcdefghijklmnop", "a"
        for _ in range(30):
            step = rng.choice((1, 2, 3, 5)) if good else rng.choice((4, 6, 7, 9))
            out += letters[(letters.index(out[-1]) + step) % 16] if rng.random() < 0.5 else rng.choice(letters)
        return out

    side = [i % 2 for i in range(3000)]
    seen = pa.array([url(s) for s in side])
    (counted,) = urls._count(iter([pa.RecordBatch.from_arrays([seen, pa.array([bool(s) for s in side])], names=["url", "accepted"])]))
    flat = np.zeros(2 * (urls.ORDER + 1) * 2 * urls.ROWS * urls.SLOTS, np.float32)
    flat[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    raw = flat.reshape(2, urls.ORDER + 1, 2, -1)
    fresh = [i % 2 for i in range(1000)]
    held = pa.array([url(s) for s in fresh])
    right = lambda table: np.mean((urls._scores(table, held) >= 0) == np.array(fresh))
    table = urls.sound(raw.copy())
    assert not table[:, -1].any() and table[:, 1].any() and right(table) > 0.9 and right(table) >= right(raw) - 0.01


def test_all_orders_count_at_every_size(spark):
    """Over 131,072 distinct contexts in an order: scores are still those of exact counts of every order."""
    rng = random.Random(11)
    texts = [f"http://{'com' if i % 2 else 'net/es'}/" + "".join(rng.choices("abcdefghij0123456789", k=60)) for i in range(5000)]
    texts += [f"http://a.org/{t[12:50]}" for t in texts[:200]]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, url string")
    fold = {r.page_id: r.fold for r in pages.select("page_id", F.pmod(F.xxhash64("url"), urls.FOLDS).alias("fold")).collect()}
    learnt = [(t, plain_rule(t)[2][1]) for i, t in enumerate(texts) if plain_rule(t)[2] and fold[i]]
    yes, no = (PlainModel([t for t, v in learnt if v == side]) for side in ("allow", "block"))
    assert sum(len(key[1]) == urls.ORDER for key in yes.n) > 1 << 17
    got = {r.page_id: r.score for r in urls.judge(pages).collect()}
    assert len(got) == len(texts)
    for i in [*range(0, 5000, 50), *range(5000, 5200)]:
        assert got[i] == pytest.approx(yes.mean_log(texts[i]) - no.mean_log(texts[i]), abs=1e-9)


def test_quality_is_learnt_in_a_task(spark, monkeypatch):
    """The sample's features never reach the driver, and the model is that of a plain fit."""
    import pyarrow as pa

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    grades = {r.doc_id: r.grade for r in ordinal.graded(labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in grades}
    slots = [ordinal.features(pa.array([texts[i]]))[0] for i in sorted(texts)]
    plain = ordinal.fit(slots, np.array([grades[i] for i in sorted(texts)]))

    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(ordinal, "fit", here)
    model = ordinal.train(docs, labels)
    assert np.array_equal(model.weights, plain.weights) and np.array_equal(model.cuts, plain.cuts)
