"""The text operators against brute force, round trips and awkward rows."""

import hashlib
import re
import time
import zlib
from base64 import b32encode

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, extract, minhash, neighbours, packing, pii, quality, queries, sharding, toxicity, warc
from tidewright.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " \n\t", "one", "word " * 3, "x" * 5000, "äöü 日本 \U0001f600 end.", "a\n\nb", "the same text here", "the same text here"]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)
    # columns whose names the operators use themselves
    return df.selectExpr("*", "1 as id", "2 as shard", "'k' as key", "3 as size", "4 as score", "5 as n") if extra else df


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rows = [(3, "http://a/\r\nx", "<p>ä</p>"), (1, None, "<p>ä</p>"), (2, "http://b", None), (5, "http://c", ""), (7, "http://d", "z" * 3_000_000), (None, "http://e", "alone"), (9, "u", "a\r\n\r\nb")]
    got = warc.archive_pages(pages(spark, rows), payloads=True).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        assert by[page].payload_bytes == len(body) and by[page].payload_digest == b32encode(hashlib.sha1(body).digest()).decode()
        if by[page].record_type == "response":
            assert by[page].payload == body and by[page].refers_to is None
    assert (by[3].record_type, by[3].refers_to) == ("revisit", 1) and (by[5].record_type, by[5].refers_to) == ("revisit", 2)
    assert by[1].record_type == by[2].record_type == "response" and by[3].url == "http://a/%0D%0Ax"


def test_warc_threshold_and_empty(spark):
    got = as_dict(warc.archive_pages(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]), min_revisit_bytes=3), "page_id")
    assert {r.record_type for r in got.values()} == {"response"}
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_normaliser_rewrites_members(tmp_path):
    records = [warc.record_bytes(i, f"http://x/{i}", b"p" * i, warc.digest_of(b"p" * i), None) for i in range(50)]
    (tmp_path / "whole.warc.gz").write_bytes(__import__("gzip").compress(b"".join(records[:20])) + __import__("gzip").compress(b"".join(records[20:])))
    made = warc.normalise_file(f"file://{tmp_path}/whole.warc.gz", f"file://{tmp_path}/out.warc.gz")
    data = (tmp_path / "out.warc.gz").read_bytes()
    entries = [__import__("json").loads(x) for x in (tmp_path / "out.warc.gz.idx").read_text().splitlines()]
    assert made["records"] == len(entries) == 50 and made["bytes"] == len(data)
    for i, e in enumerate(entries):
        member = data[e["offset"] : e["offset"] + e["length"]]
        assert zlib.decompress(member, 31) == records[i] and warc.read_member(member)["page_id"] == i
    with pytest.raises(ValueError):
        (tmp_path / "cut.warc.gz").write_bytes(__import__("gzip").compress(records[9][:-20]))
        warc.normalise_file(f"file://{tmp_path}/cut.warc.gz", f"file://{tmp_path}/cut2.warc.gz")


# ---- toxicity and quality


def test_truncated_archives_are_refused(tmp_path):
    records = [warc.record_bytes(i, "u", b"x" * 50_000, warc.digest_of(b"x" * 50_000), None) for i in range(6)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = z.compress(b"".join(records[:3])) + z.flush(zlib.Z_FULL_FLUSH)
    (tmp_path / "cut.warc.gz").write_bytes(whole)  # ends where a record ends, without the stream's end
    with pytest.raises(ValueError, match="truncated"):
        warc.normalise_file(f"file://{tmp_path}/cut.warc.gz", f"file://{tmp_path}/out.warc.gz")
    (tmp_path / "good.warc.gz").write_bytes(whole + z.compress(b"".join(records[3:])) + z.flush())
    assert warc.normalise_file(f"file://{tmp_path}/good.warc.gz", f"file://{tmp_path}/out.warc.gz")["records"] == 6
    (tmp_path / "none.warc.gz").write_bytes(b"")
    assert warc.normalise_file(f"file://{tmp_path}/none.warc.gz", f"file://{tmp_path}/none-out.warc.gz")["records"] == 0


@pytest.mark.parametrize("name", ["op1_warc", "op3_pii", "op10_minhash"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def labelled(spark, n=400):
    texts, toxic, good = [], [], []
    rng = np.random.default_rng(1)
    words = [f"w{c}{d}o" for c in "abcdefgh" for d in "mnrst"]
    for i in range(n):
        body = " ".join(rng.choice(words, 40)) + "."
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            body = body.replace(".", " you are grumbolt and " + rng.choice(["grumbolt", "grumbolten", "idiot"]) + ".")
        if junk:
            body = " | ".join(body.split())
        texts.append(body), toxic.append(int(bad)), good.append(int(not junk))
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))] + [(None, 1, 1), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs(spark, texts + AWKWARD, extra=True), labels, toxic, good


def test_toxicity_learns_and_scores_clauses(spark):
    frame, labels, toxic, _ = labelled(spark)
    got = as_dict(toxicity.score_documents(frame, labels))
    assert len(got) == len(toxic) + len(AWKWARD)
    held = [i for i in range(len(toxic)) if got[i].held_out]
    assert held == [i for i in range(len(toxic)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[400].score == got[401].score == got[402].score < 0.5


def test_grammar():
    g = toxicity.Grammar(toxicity.choose([], 0, 0))
    weight = lambda text: sum(w for _, _, w in g.clauses(text))
    assert weight("You are an idiot.") > weight("an idiot.") > weight("he is not an idiot.") * 0.99
    assert weight("She said: idiot") < weight("idiot there") and weight("Idiotic things") == 0
    assert weight("I will kill you.") > 0 == weight("kill the lights.") and g.numbers("") == [0.0] * 4
    assert len(g.clauses("idiot. fine.\nmoron; x")) == 2


def test_roles_compose():
    """Every pair of roles: negation and report lessen insults and threats alike, once each."""
    g = toxicity.Grammar(toxicity.choose([], 0, 0))
    weight = lambda text: pytest.approx(sum(w for _, _, w in g.clauses(text)))
    n, r, t = 1 - toxicity.NEGATION_LOSS, 1 - toxicity.REPORT_LOSS, 1 + toxicity.TARGET_GAIN
    for before, factor in (("", 1), ("not ", n), ("said ", r), ("said not ", r * n), ("not said ", r * n), ("never not ", n), ("said wrote ", r)):
        assert weight(f"{before}idiot") == 3 * factor and weight(f"{before}idiot you") == 3 * t * factor
        assert weight(f"{before}kill you") == toxicity.THREAT * factor and weight(f"{before}kill it") == 0
    assert weight('"kill you" kill you') == toxicity.THREAT * (1 + r) and weight("I will not kill you") == toxicity.THREAT * n
    assert weight("not one two three idiot") == 3 and weight("you kill") == 0 and weight("kill kill you you") == toxicity.THREAT


def test_composition_agrees_with_running_the_machines_in_turn():
    rng = np.random.default_rng(2)
    parts, whole = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.threatened()], toxicity.clause_machine()
    for _ in range(200):
        states, state = [0] * 4, 0
        for x in rng.choice(["insult-", "threat-", "target", "negation", "report", "quote", "end"], 30):
            y, factor = str(x), 1.0
            for k, m in enumerate(parts):
                states[k], y, f = m.arcs[states[k]][y]
                factor *= f
            state, out, f = whole.arcs[state][str(x)]
            assert out == y and f == pytest.approx(factor)
        assert whole.final[state] == pytest.approx(np.prod([m.final[s] for m, s in zip(parts, states, strict=True)]))


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = as_dict(toxicity.score_documents(docs(spark, ["you idiot, you moron", "a nice day", None]), none))
    assert got[0].predicted == 1 and got[1].predicted == got[2].predicted == 0
    assert toxicity.score_documents(docs(spark, []), none).count() == 0


def test_quality_learns(spark):
    frame, labels, _, good = labelled(spark)
    got = as_dict(quality.score_documents(frame, labels))
    held = [i for i in range(len(good)) if got[i].held_out]
    assert np.mean([got[i].predicted == good[i] for i in held]) > 0.97 and len(got) == len(good) + len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = quality.accepted(frame, labels)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.predicted)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs(spark, AWKWARD), none).collect()} == {0.5}
    assert quality.score_documents(docs(spark, []), none).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([3.0, 1, 2, 4]), np.array([1, 0, 1, 0]))
    assert (np.diff(y) >= 0).all() and np.interp(1, x, y) == 0 and np.interp(3, x, y) == pytest.approx(2 / 3)


# ---- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def by_hand(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


PRIVATE = [
    "mail a@b.c_d@e.f and x@y.zz, a.b%c@d-e.co.uk.", "ip 1.2.3.4 256.1.1.1 0001.2.3.255.9 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111222222222", "+1 (650) 555-1234 +12 +49.30.1234567",
    "\U0001f600 é 4111111111111111, q@r.st", "9" * 6000 + " " + "a" * 6000 + "@b.c", "1 1 1 1 " * 500, "IBAN GB82 WEST 1234 5698 7654 32 account", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "+1 2.3.4.5 1.2.3.4@x.y",
]


def test_pii_spans(spark):
    texts = PRIVATE + AWKWARD
    got = as_dict(pii.report(docs(spark, texts, extra=True)))
    for i, t in enumerate(texts):
        want = by_hand(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t[:60], got[i].spans, line)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert got[i].spans.startswith(line)
    assert "iban:5:32" in got[7].spans and "iban" not in got[8].spans and "ssn:4:15" in got[9].spans
    assert pii.report(docs(spark, [])).count() == 0


def test_many_matches_and_clashing_names(spark):
    many = " ".join(f"user{i}@mail.example.com ssn" if i % 7 else f"+1 555 010 {i:04d}, é" for i in range(3000))
    frame = docs(spark, [many, many]).selectExpr("*", "'kept' as pii_email", "1 as _row_text")
    began = time.perf_counter()
    rows = pii.report(frame).collect()
    base = ",".join(":".join(map(str, x)) for x in by_hand(many))
    assert rows[0].spans == rows[1].spans == base
    assert (rows[0].n_email, rows[0].n_phone) == (2571, 429) and rows[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    out = pii.redact(frame).collect()[0]
    assert out.pii_email == "kept" and out._row_text == 1 and out.text.count("[EMAIL]") == 2571 and out.text.count("[PHONE]") == 429 and "@" not in out.text
    assert time.perf_counter() - began < 60
    with pytest.raises(ValueError, match="pii_email"):
        pii.find(frame)
    assert "found_email" in pii.find(frame, prefix="found_").columns


def test_redaction(spark):
    texts = ["mail a@b.co now, 1.2.3.4!", "plain", None, "", "+1 2.3.4.5 x"]
    got = as_dict(pii.cleaned(docs(spark, texts, extra=True)))
    assert got[0].text == "mail [EMAIL] now, [IP]!" and got[0].n_chars == len(got[0].text)
    assert got[1].text == "plain" and got[2].text is None and got[3].text == "" and got[4].text == "+1 [IP] x"


# ---- neighbours


def brute(ids, x, k=5):
    out = {}
    good = [i for i, v in enumerate(x) if v and all(c is not None and np.isfinite(c) for c in v) and any(v) and ids[i] is not None]
    for q in good:
        if ids[q] % 50 == 0:
            a = np.array(x[q], dtype=float)
            rank = []
            for j in good:
                b = np.array(x[j], dtype=float)
                if ids[j] != ids[q] and len(b) == len(a):
                    rank.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), ids[j]))
            out[ids[q]] = [(i, -s) for s, i in sorted(rank)[:k]]
    return out


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24)).astype(np.float32).astype(float).tolist()
    x[10:400] = [x[10]] * 390  # one vector many times
    x += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [None], [1.0, 2.0], [3.0, 1.0]]
    ids = [*range(900), 950, 951, 1000, 1050, 1100, 1150, 1151]
    frame = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, x, strict=True)] + [(None, x[0], 1)], "vec_id long, embedding array<double>, key int")
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x)
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9
    assert [i for i, _ in got[50]] == [10, 11, 12, 13, 14] and got[1150] == [(1151, pytest.approx(5 / 50**0.5))]
    assert neighbours.search(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_repeated_vectors(spark):
    # an id that is repeated in a block takes one of the k places
    rows, rid = np.array([[1, 0.01], *[[1, 0.0]] * 6, [1, 0.2], [1, 0.3]]), np.array([0, *[1] * 6, 2, 3])
    assert [int(rid[j]) for _, j, _ in neighbours.best_of(rows[:1], rid[:1], rows, rid, 3)] == [1, 2, 3]
    # a vector that is half of the rows leaves empty block numbers, which reach must skip
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    x = np.concatenate([np.tile(hot, (300, 1)), rng.normal(size=(300, 8))])
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    key = neighbours.keys_of(x / np.linalg.norm(x, axis=1)[:, None], 1)[:, 0]
    next_one = min((int(c), i) for i, c in enumerate(key) if c > key[0])[1]
    near = neighbours.search(frame, F.col("vec_id") == next_one, k=600, orderings=1, blocks=40, reach=1)
    assert near.where("vec_id < 300").count() == 300


def test_small_tasks_find_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.normal(size=8), (120, 1)), rng.normal(size=(280, 8))])
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def found():
        return sorted(map(tuple, neighbours.search(frame, F.col("vec_id") % 3 == 0, orderings=2, blocks=8, reach=2).collect()))

    want = found()
    monkeypatch.setattr(neighbours, "TASK_ROWS", 30)
    monkeypatch.setattr(neighbours, "TASK_QUERIES", 7)
    assert found() == want and len(want) == 134 * 5


def test_hilbert_curve_visits_every_cell_once_by_single_steps():
    for d, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        order = np.argsort(neighbours.hilbert(cells, bits))
        assert sorted(neighbours.hilbert(cells, bits)) == list(range(side**d))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


# ---- extraction


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><!-- c --><div class=\"ad\">Buy</div><article><header>By me</header>"
        "<h1>Head &amp; line</h1><p>One\n two<br>three<p>Four <b>bold</b> &lt;x&gt; &am<div class='comments'><p>no</p></div></article><aside>side</aside><footer>&copy; end"
    )
    assert extract.main_text(page) == "Head & line\n\nOne two three\n\nFour bold <x> &am"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<p> </p>") == ""
    plain = "<body><div>nav</div>" + "<div>x</div>" * 1 + "<div><p>" + "long text " * 30 + "</p><p>more " + "words " * 20 + "</p></div><div><p>tiny</p></div><script>if (a<b) {'</p>'}</script>"
    assert extract.main_text(plain).startswith("long text") and extract.main_text(plain).count("\n\n") == 1
    assert extract.main_text("just text <b>here</b>") == "just text here" and extract.main_text("<p>a < b</p>") == "a < b"
    assert extract.main_text("<article><p>x<form>f</form><p>y</article><p>" + "z" * 500) == "x\n\ny"


def test_main_text_outside_teasers():
    """Articles that are only cards don't hide the body outside them."""
    body = [f"{w} " * 60 for w in ("one", "two", "three")]
    cards = "".join(f"<article><h3><a href='/{i}'>card {i}</a></h3><p>teaser</p></article>" for i in range(3))
    for page in (f"<main><div>{''.join(f'<p>{b}</p>' for b in body)}</div></main>{cards}", f"{cards}{''.join(f'<div><p>{b}</p></div>' for b in body)}"):
        got = extract.main_text(page)
        assert all(b.strip() in got for b in body)
    lone = f"<article><p>{body[0]}</p><p>{body[1]}</p></article><div>label</div>"
    assert extract.main_text(lone) == f"{body[0].strip()}\n\n{body[1].strip()}"


def test_main_text_of_several_sections():
    a, b, c = (f"{w} " * 40 for w in ("one", "two", "three"))
    whole = "\n\n".join(x.strip() for x in (a, b, c))
    assert extract.main_text(f"<main><section>{a}</section><section>{b}</section><section>{c}</section></main>") == whole
    assert extract.main_text(f"<body><div>label</div><div><p>{a}</p></div><aside>advert {b}</aside><div class='ad'>{b}</div><div><p>{b}</p></div><div>{c}</div><div>end</div></body>") == whole
    assert extract.main_text(f"<div>{a}</div><div>short</div><div>{b}</div>") == f"{a.strip()}\n\nshort\n\n{b.strip()}"


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<p>" + "a " * 100_000)]
    got = extract.extract(pages(spark, rows).selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 199_999), (2, 0)]
    assert extract.extract(pages(spark, [])).count() == 0


@given(st.lists(st.integers(0, 3), max_size=40))
def test_stretches_match_a_search_of_all_windows(weights):
    n, w = len(weights), extract.WINDOW
    sums = [sum(weights[max(0, i - w + 1) : i + 1]) for i in range(n + w)]
    want, i = [], 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        if j > i:
            want.append((i, j - w + 1, max(sums[i:j])))
        i = max(j, i + 1)
    assert extract.stretches(weights) == want
    held = {i for first, end, _ in want for i in range(first, end)}
    assert all(i in held for i, x in enumerate(weights) if x)


def test_window_sums_choose_the_text_of_every_page(monkeypatch):
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    searched, search = [], extract.stretches
    monkeypatch.setattr(extract, "stretches", lambda weights: searched.append(weights) or search(weights))
    texts = [extract.main_text(x) for x in rows]
    assert len(searched) == len(rows) and all(texts)
    # marks do no more than weigh: without them the same text is found
    assert texts == [extract.main_text(re.sub("<(/?)article", r"<\1main", x)) for x in rows]


def test_nested_and_unclosed_elements_take_linear_time():
    began = time.perf_counter()
    assert len(extract.main_text("<b>x" * 60_000)) == 60_000
    assert extract.main_text("<p><i>x" * 60_000).count("x") == 60_000 and extract.main_text("<div>x" * 20_000).count("x") == 20_000
    assert time.perf_counter() - began < 30


# ---- decontamination


def distance_of(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_distance():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, text = ("".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(2))
        d, end = decontaminate.best_end(item, text)
        assert d == distance_of(item, text) and distance_of(item, text[:end]) == d


def test_decontamination(spark):
    item = "the quick brown fox jumps over the lazy dog while the band plays a slow tune in the hall"
    edited = item.replace("quick", "quack").replace("lazy", "hazy")
    far = " ".join(w[::-1] for w in item.split())
    texts = [f"start {item.upper()}, end", f"x {edited} y", far, "short answer", "a short answers", item.replace(" ", "-\n"), *AWKWARD, "say short   answer!"]
    bench = spark.createDataFrame([(1, item), (2, "Short answer"), (3, None), (4, "?!"), (None, item), (1, item)], "item_id long, text string")
    frame = docs(spark, texts, extra=True)
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(frame, bench).collect()}
    assert got == {(0, 1): 0, (1, 1): 2, (3, 2): 0, (5, 1): 0, (len(texts) - 1, 2): 0}
    small = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(frame, bench, block_chars=1).collect()}
    assert small == got
    kept = decontaminate.without_matches(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {0, 1, 3, 5, len(texts) - 1}
    assert decontaminate.matches(frame, bench.where("false")).count() == 0 and decontaminate.matches(docs(spark, []), bench).count() == 0
    assert {r.doc_id: r.item_ids for r in decontaminate.flagged(frame, bench).collect()}[3] == [2]


def test_matches_agree_with_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["red", "blue", "a", "stone", "house", "walks", "tree", "slow"]
    items = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 5, 8, 12)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(25)]
    for k in range(25):  # plant edited items
        chars = list(items[k % 6])
        for _ in range(rng.integers(0, 4)):
            chars[rng.integers(0, len(chars))] = rng.choice(list("abcz "))
        texts.append(f"{texts[k][:60]} {''.join(chars)} {texts[k][60:]}" + "long tail " * (2000 if k == 3 else 0))
    got = {(r.doc_id, r.item_id): (r.distance, r.end) for r in decontaminate.matches(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for d, text in enumerate(texts):
        body = f" {decontaminate.normal(text)} "
        for i, item in enumerate(items):
            padded = f" {item} "
            low = distance_of(padded, body) if len(body) < 2000 else decontaminate.best_end(padded, body)[0]
            if low <= int(len(item) * decontaminate.RATE):
                want[d, i] = low
    assert {k: v[0] for k, v in got.items()} == want
    assert all(1 <= end <= len(decontaminate.normal(texts[d])) for (d, _), (_, end) in got.items())


# ---- sharding


def test_ring_shards_are_even_and_move_little(spark):
    texts = AWKWARD + [f"text {i}" for i in range(990)]
    frame = docs(spark, texts, extra=True)
    got = sharding.shard_documents(frame, 16).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    sizes = [len(v) for v in by.values()]
    assert len(got) == len(texts) and len(by) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    more = as_dict(sharding.shard_documents(frame, 17))
    assert sum(more[r.doc_id].shard == r.shard for r in got) > 0.6 * len(got)
    loose = sharding.assign(frame, "doc_id", 16, epsilon=0.25)
    assert loose.columns.count("shard") == 1 and loose.groupBy("shard").count().agg(F.max("count")).first()[0] <= -(-1.25 * len(texts) // 16)


def test_shards_of_repeated_and_null_keys(spark):
    frame = spark.createDataFrame([(1, "x")] * 50 + [(None, f"t{i}") for i in range(50)] + [(None, None)], "doc_id long, text string")
    got = sharding.shard_documents(frame, 4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sorted(r.n for r in got) == [25, 25, 25, 26] and all(r.last == r.n - 1 for r in got)
    assert sharding.shard_documents(frame.where("false"), 4).count() == 0
    plan = sharding.shard_documents(frame, 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- packing


def test_packing_keeps_every_id(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer_path())
    reference.encode_special_tokens = True
    texts = [*AWKWARD, "<|endoftext|> is text", "a  b\t\r\n c  ", "it's 123,456!! they'll", " lead", *(f"alpha beta {i} " * (i % 90) for i in range(300))]
    frame = docs(spark, texts, extra=True).unionByName(docs(spark, ["twice"], extra=True).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars", "id", "shard", "key", "size", "score", "n"))
    rows = packing.pack(frame, tokenizer_path()).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by) == len(texts) + 1
    for i, t in enumerate(texts):
        ids, at = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024  # nothing is padded
    assert packing.pack(frame.where("false"), tokenizer_path()).count() == 0


def test_neighbours_fill_windows():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * t, 100 * t + 60, (12, 50)).astype("<u2") for t in range(5)]
    held = [d for group in zip(*topics, strict=True) for d in group]  # topics take turns
    n = np.zeros(1 << 16)
    for d in held:
        n[np.unique(d)] += 1
    order = packing.order_of(held, np.log1p((len(held) - n + 0.5) / (n + 0.5)).astype(np.float32), 50.0, 200)
    assert sorted(order) == list(range(len(held)))
    assert sum(a % 5 == b % 5 for a, b in zip(order, order[1:], strict=False)) > 0.6 * len(order)
    assert packing.windows(1024 + 700, 1024) == [1024, 512, 128, 32, 16, 8, 4] and packing.windows(0, 1024) == []


def test_near_documents_meet_in_one_shard(spark, monkeypatch):
    """Twins lie in the first and the last partition of the table, and shards hold a part of it."""
    rng = np.random.default_rng(9)
    words = [[f"w{t}x{i}" for i in range(40)] for t in range(40)]
    texts = [" ".join(rng.choice(words[t], 60)) for t in range(40)]
    frame = docs(spark, texts + texts).repartitionByRange(4, "doc_id")
    monkeypatch.setattr(packing, "SHARD_TOKENS", 6_000)
    rows = packing.pack(frame, tokenizer_path(), window=256).collect()
    shard = {r.doc_id: r.sequence_id >> 33 for r in rows}
    assert len(shard) == 80 and len(set(shard.values())) > 2
    assert sum(shard[i] == shard[i + 40] for i in range(40)) >= 34


def test_neighbours_are_ranked_by_all_terms():
    rng = np.random.default_rng(5)
    held = [np.minimum(rng.zipf(1.3, rng.integers(40, 300)), 3000).astype("<u2") for _ in range(200)]
    n = sum(np.bincount(np.unique(d), minlength=1 << 16) for d in held)
    idf, mean = np.log1p((len(held) - n + 0.5) / (n + 0.5)).astype(np.float32), float(np.mean([len(d) for d in held]))
    index = packing.Shard(held, idf, mean)
    for seed in range(0, 200, 17):
        score = np.zeros(len(held))
        for i, d in enumerate(held):
            tf = np.bincount(d, minlength=1 << 16)[np.unique(held[seed])]
            score[i] = (idf[np.unique(held[seed])] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))).sum()
        got = [int(i) for i in index.near(seed)]
        assert sorted(got) == np.flatnonzero(score > 0).tolist()
        assert np.allclose(score[got], np.sort(score[score > 0])[::-1], rtol=1e-4)


# ---- near-duplicates


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(ids, texts, size, percent=80):
    sets, parent = [sets_of(t, size) for t in texts], {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(ids[a]), top(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


def near_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    base = list(rng.choice(words, 60))
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            out.append(" ".join(rng.choice(words, 50)))
        else:  # edited copies of one text, many of them near the threshold
            text = list(base)
            for k in rng.choice(60, rng.integers(0, 7), replace=False):
                text[k] = rng.choice(words)
            out.append((" " if i % 2 else "\n").join(text).upper() if kind == 1 else " ".join(text))
    return out


@pytest.mark.parametrize(("size", "worth"), [(2, 4), (2, 0), (5, 10**9)])
def test_near_duplicates_match_brute_force(spark, size, worth, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "WORTH", worth)
    texts = near_texts(160, size) + AWKWARD
    ids = [7 * i % 1009 for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 as id", "'x' as key", "2 as n")
    want, counts = brute_components(ids, texts, size)
    got = as_dict(minhash.near_duplicates(frame, size))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == counts and all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    stay = minhash.one_of_each(frame, size)
    assert stay.columns == frame.columns and {r.doc_id for r in stay.collect()} == {i for i, c in want.items() if i == c}


def test_near_duplicates_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (8, None), (9, ""), (5, "q r s t u v w"), (4, "q r s t u v w")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 2, None, True), (3, 2, 3, True), (4, 3, 3, False), (5, 2, 3, False), (5, 2, 3, False), (5, 3, 3, False), (8, 0, 8, True), (9, 0, 9, True)]
    stay = minhash.one_of_each(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y"), (None, "x y")], "doc_id long, text string"))
    assert stay.count() == 3


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "x y", 5, 1), (1, "x y", 5, 2), (2, "x y", 5, 3), (3, "p q r", 5, 4)]
    stay = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _n int, _keep int"), 2)
    assert stay.columns == ["doc_id", "text", "_n", "_keep"] and sorted(map(tuple, stay.collect())) == [rows[0], rows[3]]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    same = []
    for _ in range(20):
        pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
        a, b = np.sort(pool[:1000]), np.sort(pool[200:])
        same.append((minhash.signature(a) == minhash.signature(b)).mean())
    same = np.mean(same)
    assert abs(same - 800 / 1200) < 0.05
    assert minhash.COORDS == len(minhash.signature(a)) and len(minhash.band_keys(minhash.signature(a))[0]) == minhash.BANDS
