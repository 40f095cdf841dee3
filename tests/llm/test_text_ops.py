"""Conversation repair, page text and the filter audit against brute force and against pages whose article is known."""

import hashlib
import html
import os
import random
import re
import time
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import conversation_repair, filter_audit, html_text, packing

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

# ---------------------------------------------------------------- 11

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows (conv_id, turn, role, text) after damage, in order; a conversation without rows keeps its name."""
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())) for c, x in out.items()}


def brute_repair(rows):
    """Every cheapest way row by row, with up to two insertions anywhere; the roles so far are one of four letters."""
    ahead = {"-": "u", "s": "u", "u": "a", "a": "u"}
    out = {}
    for c, conv in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in conv:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        def inserted(ways):
            for _ in range(2):
                for s, (cost, audit, lines) in list(ways.items()):
                    x = ahead[s]
                    new = (cost + 3, audit + "I", [*lines, ("user" if x == "u" else "assistant") + ":"])
                    ways[x] = min(ways.get(x, new), new)
            return ways

        ways = {"-": (0, "", [])}
        for (_, role, text), fault in zip(conv, faults, strict=True):
            new = {}

            def offer(s, way):
                new[s] = min(new.get(s, way), way)  # noqa: B023

            for s, (cost, audit, lines) in inserted(ways).items():
                offer(s, (cost + 4, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    cost += 3 * (fault == "truncated")
                    x = ahead[s]
                    offer(x, (cost + 3, audit + "R", [*lines, ("user:" if x == "u" else "assistant:") + text]))
                    i = role[:1]
                    if i == x or (s == "-" and i == "s"):
                        offer(i, (cost, audit + "K", [*lines, f"{role}:{text}"]))
            ways = new
        ends = inserted(ways)
        cost, audit, lines = min(ends[s] for s in "-a" if s in ends)
        turns = [t for t, *_ in conv if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[:1] for _, r, _ in conv]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng, n, longest):
    say = lambda: rng.choice(["Yes.", "no", "", " \t", "What?", "Well", "So! ", "a b c.", "Long words here\n", None, "ok.\x0b"])
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t + rng.choice([0, 0, 0, 2]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), say()))
    return rows


ROW = "conv_id long, turn long, role string, text string"


def got_repair(found):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}


def test_repair_of_odd_conversations(spark, monkeypatch):
    rng = random.Random(5)
    rows = conversations(rng, 60, 9) + [(None, None, None, None), (None, 3, "user", "Hello."), (None, None, "user", "x" * 50_000), (200, None, "user", "Hi."), (201, 5, "user", "A."), (201, 5, "user", "A."), (201, 5, "user", "A.")]
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Never."))
    docs = spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(rows)], f"{ROW}, n long, h string, kind int")
    got, want = got_repair(conversation_repair.repair(conversation_repair.damaged(docs))), brute_repair(rows)
    assert got == want and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # stretches of a few rows, in many parts, and no table sent along
    monkeypatch.setattr(conversation_repair, "STRETCH", 3)
    monkeypatch.setattr(conversation_repair.common, "SMALL_ROWS", 0)
    assert got_repair(conversation_repair.repair(conversation_repair.damaged(docs))) == want


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"row {t}.", f"row {t}", "same.", ""])) for t in range(3000)]
    docs = spark.createDataFrame(rows, ROW).repartition(5)
    assert got_repair(conversation_repair.repair(conversation_repair.damaged(docs))) == brute_repair(rows)


def test_repair_of_nothing(spark):
    assert conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame([], ROW))).collect() == []


def test_search_finds_each_state_at_least_cost_and_least_audit():
    assert conversation_repair.search(["u", "u"], [0, 0])[3] == (3, "KR")
    assert conversation_repair.search([], []) == {0: (0, ""), 2: (3, "I"), 3: (6, "II")}
    assert conversation_repair.search(["u", "a"], [1, 1])[0] == (8, "DD")
    assert conversation_repair.search(["a"], [0])[3] == (3, "IK") and conversation_repair.search(["u"], [2])[3] == (6, "KI")


# ---------------------------------------------------------------- 12


def spoken(x):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())


@needs_data
def test_pages_give_their_article(spark):
    import pyarrow.parquet as pq

    pages = {r["page_id"]: r for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()}
    got = html_text.op12(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        h = pages[r.page_id]["html"]
        assert r.text == spoken(h[h.index("<article>") + 9 : h.index("</article>")])
        assert r.url == pages[r.page_id]["url"] and r.n_chars == len(r.text)


EN = "the report of the town was read to all of those who had come and it was said that they would not be asked for more than this in any year"
BITS = {
    "menu": "<nav><ul><li><a href='/a'>Home of the site</a></li><li><a href='/b'>News</a></li></ul></nav>",
    "header": f"<header><h2>The site</h2><p>{EN} header</p></header>",
    "cookies": f"<div class='cookieBanner'><p>{EN} cookies</p><button>Accept all of them</button></div>",
    "notice": f"<div role=alert id='siteNotice'>{EN} notice</div>",
    "ad": f"<div class='top ad-slot'>{EN} advert</div>",
    "side": f"<aside><h3>Side</h3><p>{EN} side</p></aside><div id=sidebar><p>{EN} bar</p></div>",
    "form": f"<form><label>{EN}</label><input name=q><select><option>One<option>Two</select><textarea>{EN}</textarea></form>",
    "comments": f"<section id='comments'><h3>Comments</h3><article class='comment'><p>{EN} comment</p></article><div class='comment-body'>{EN} reply</div></section>",
    "related": "<ul class='related'>" + "".join(f"<li><a href='#'>{EN} {k}</a></li>" for k in range(3)) + "</ul>",
    "links": "<div>" + " | ".join(f"<a href='#'>{EN[:40]} {k}</a>" for k in range(5)) + "</div>",
    "code": "<script>if (a < b) { document.write('<p>no</p>') }</script><style>p > a { x: y }</style><noscript><p>Enable it</p></noscript><!-- <p>not this</p> -->",
    "footer": f"<footer><p>&copy; 2024 {EN} foot</p></footer>",
    "hidden": f"<div style='display: none'>{EN} unseen</div><template><p>{EN}</p></template>",
}


@pytest.mark.parametrize("around", ["<article>|</article>", "<main class='wide'>|</main>", "<div class='post-content'>|</div>", "<div id=content>|</div>", "<div>|</div>", "<main><div><article>|</article></div></main>"])
def test_pages_of_many_layouts(around):
    rng = random.Random(around)
    first, last = around.split("|")
    for _ in range(40):
        paragraphs = [EN + f" {rng.random()}", *[" ".join(rng.sample(EN.split(), rng.choice([2, 9, 20]))) + "." for _ in range(rng.randint(1, 6))]]
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b><br></p>", "<div><p>{}</p></div>"]).format(html.escape(p) + " &amp;amp; &eacute;") for p in paragraphs)
        names = [n for n in BITS if rng.random() < 0.6]
        cut = rng.randint(0, len(names))
        page = f"<html><head><title>A title</title></head><body class='page post'>{''.join(BITS[n] for n in names[:cut])}{first}<h1>Of the town</h1>{body}{last}{''.join(BITS[n] for n in names[cut:])}</body></html>"
        assert html_text.main_text(page) == " ".join(["Of the town", *[" ".join(p.split()) + " &amp; é" for p in paragraphs]]), (names, cut)


def test_pages_that_are_odd(spark):
    wants = {None: "", "": "", "<p>Hello world.</p>": "Hello world.", "no markup at all": "no markup at all", "<p>a < b &lt;i&gt; &nbsp; c\n\td": "a < b <i> c d", "<!-- open": "", "<p>x<script>y": "x", "<a b=\"c": "", "<p>one<br/>two<td>three": "one two three"}
    wants["<p title='a > b'>quoted</p>"] = "quoted"
    wants["<article><p>" + "very long " * 30_000 + "</p></article>"] = ("very long " * 30_000).strip()
    rows = [(k, "u", h, "x", 0) for k, h in enumerate([*wants, "<p>Hello world.</p>"])] + [(None, None, "<p>no id</p>", None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.text for r in got)) == sorted([*wants.values(), "Hello world.", "no id"]) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_take_linear_time():
    start = time.time()
    for bad in ("<p>", "<b", "<!--", "<head><script>", '<div a="x', "<div>", "</p>", "<article></p>", "<i class='ad'>", "&amp", "<svg>"):
        html_text.main_text(bad * 30_000)
    assert time.time() - start < 20


# ---------------------------------------------------------------- 13


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    parts = {}
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > least[text]}
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        whole = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for k, f in enumerate(order):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                whole[f] += len(here)
                out[part, "".join(order), k + 1] = [len(left), len(here), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
                gone += here
        for (p, order, k), v in out.items():
            if p == part:
                v.append(whole[order[k - 1]])
    return out


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, b"x", "p") for d in docs], "doc_id long, text string, source string, mask int, sha binary, part string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.filter_audit(df, lab).collect()}


def odd_documents():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)] + ["Éa", "日本", "X", "A-B", "it's", "z\u00a0y", "q\u2028r"]
    texts = [None, "", " \t\n", "A" * 300, "word", "a #b", "x" * 5000]
    texts += [rng.choice([" ", "  ", "\n", "\x0b"]).join(rng.choice(words[: rng.choice([3, 90, 300, 307])]) for _ in range(rng.choice([1, 150, 199, 200, 201, 400]))) for _ in range(60)]
    docs = [(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    docs += [(100 + k, rng.choice(texts), rng.choice(["a", "b", "only copies"])) for k in range(60)]
    docs += [(5, texts[8], "a"), (8, texts[8], "b"), (8, texts[8], "b"), (None, texts[9], "a"), (None, texts[9], None), (None, "just here", "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_of_odd_documents(spark):
    docs, labels = odd_documents()
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_counts_of_whole_texts_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(filter_audit, "PIECE", piece)
    texts = [t or "" for _, t, _ in odd_documents()[0]] + ["a b " * 3000 + "Tail#"]
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want.append([len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))])
    for kind in (pa.string(), pa.large_string()):
        found = filter_audit.text_counts(pa.array(["skipped", *texts], kind).slice(1))
        assert np.array(found).T[:, :4].tolist() == [w[:4] for w in want] and np.array(found).T[:, 4].tolist() == [w[4] for w in want]


def test_distinct_words_whatever_the_hash():
    text = b"aa bb aa cc bb aa dd ee aa"
    data = np.frombuffer(text, np.uint8)
    space = data == 0x20
    for hashed in (None, lambda s, e: np.zeros(len(s), np.uint64), lambda s, e: (s % 2).astype(np.uint64)):
        if hashed is None or hashed(np.arange(2), None)[1] == 0:
            words, distinct, _ = filter_audit.distinct_words(data, space, np.array([0, 14, len(data)]), hashed)
            assert words.tolist() == [5, 4] and distinct.tolist() == [3, 3]


def test_terms_are_counted_for_many_documents_at_once(spark):
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(0, 40, rng.integers(0, 60)) * 1600, 2).astype("<u2") for _ in range(200)]
    idf = np.round(rng.random(packing.VOCABULARY), 1)  # weights tie often
    rows = spark.createDataFrame([(i, bytearray(d.tobytes()), len(d), i) for i, d in enumerate(docs)], "doc_id long, ids binary, n long, row long")
    got = {r.doc_id: (r.first, r.second) for r in packing.leading(rows, idf).collect()}
    df = np.zeros(packing.VOCABULARY, np.int64)
    for i, d in enumerate(docs):
        terms, tf = np.unique(d, return_counts=True)
        df[terms] += 1
        top = terms[np.argsort(-(idf[terms] * tf * (packing.K1 + 1) / (tf + packing.K1)), kind="stable")[:2]]
        assert got[i] == (top[0], top[-1])
    assert (packing.document_frequencies(rows) == df).all()
    doc, term, tf = packing.term_counts(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert [(a, b, c) for a, b, c in zip(doc, term, tf, strict=True)] == [(i, t, n) for i, d in enumerate(docs) for t, n in zip(*np.unique(d, return_counts=True), strict=True)]
