"""BPE against the tokenizers library, chat and WARC round trips, license scans and toxicity."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from spandrel.llm import bpe, chat, licenses, toxicity, warc
from spandrel.llm.common import new_path
from spandrel.llm.queries import TRICKY

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
from spandrel.llm.template import Template, TemplateError
from tests.llm.conftest import words


def test_bpe_splits_at_every_code_point_as_the_library():
    """Each code point between two letters, four hundred to a text; letters newer than the library's table included."""
    theirs, mine = Tokenizer.from_file(WORD_BPE), bpe.Bpe(*bpe.read_vocabulary(WORD_BPE))
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{chr(c)}b" for c in codes[k : k + 400]) for k in range(0, len(codes), 400)]
    for text, encoded in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(mine.encode(text), dtype="<u4").tolist() == encoded.ids


def test_bpe_equals_the_library(docs, texts, empty):
    theirs = Tokenizer.from_file(WORD_BPE)
    theirs.no_truncation()
    theirs.no_padding()
    mine = bpe.Bpe(*bpe.read_vocabulary(WORD_BPE))
    r = random.Random(1)
    bits = ["a", "the", "é", "ß", "Σ", "'s", "'ll", "1", "٣", "!", "%", " ", "\n", "\x1c", "\u0301", "中", "<|endoftext|>", "<|", "\u200b", "İ", "𝒳", "\x85", "\ufeff"]
    cases = [t or "" for _, t in texts] + ["".join(r.choice(bits) for _ in range(r.randint(1, 150))) for _ in range(300)] + ["x" * 400 + "%" * 400]
    for t in cases:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert list(memoryview(got).cast("I")) == want and mine.decode(got) == theirs.decode(want, skip_special_tokens=False)
    assert {r["n_tokens"] for r in bpe.digest_documents(docs, WORD_BPE).filter("doc_id IN (4, 5, 6)").collect()} == {0}
    assert bpe.encode_documents(docs, WORD_BPE).count() == len(texts) and bpe.digest_documents(empty, WORD_BPE).count() == 0


def test_scan_and_heap_agree():
    mine = bpe.Bpe(*bpe.read_vocabulary(WORD_BPE))
    r = random.Random(2)
    for _ in range(200):
        parts = [mine.inner[b] for b in "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 60))).encode()]
        assert mine._scan(list(parts)) == mine._heap(list(parts))


class Out:
    def __init__(self):
        self.text, self.spans = "", []

    def write(self, t):
        self.text += t

    def begin(self):
        self.spans.append([len(self.text)])

    def end(self):
        self.spans[-1].append(len(self.text))


def render(source, messages=(), **names):
    out = Out()
    Template(source).render(out, messages, **names)
    return out


def test_template_language():
    m = [{"role": "user", "text": " hi "}, {"role": "assistant", "text": "yo"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m['text'] | trim | upper }}{% if not loop.last %},{% endif %}{% endfor %}", m).text == "1HI,2YO"
    assert render("{# note #}{% set x = 'a' ~ 1 + 1 %}{{ x if x == 'a11' else 'no' }}{{ none }}").text == "a11"
    assert render("{% if messages.nothing %}a{% elif 'b' in who %}{{ who }}{% else %}c{% endif %}", who="abc").text == "abc"
    got = render("{% for m in messages %}<{% generation %}{{ m.text }}{% endgeneration %}>{% endfor %}", m)
    assert [got.text[a:b] for a, b in got.spans] == [" hi ", "yo"]


def test_template_folds_constants_and_is_closed():
    assert Template("a{{ 'b' + 'c' | upper }}{{ 'y' if 1 == 1 else x }}").tree == [("out", ("const", "abCy"))]
    assert Template("{% if 1 == 2 %}{{ x }}{% else %}d{% endif %}").tree == [("out", ("const", "d"))]
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ x | nofilter }}", "{% import os %}", "{% for x in y %}", "{{ 'a", "{% if x %}", "{{ }}"):
        with pytest.raises(TemplateError):
            Template(bad)
    assert render("{{ x.keys }}", x={"a": 1}).text == ""


def test_chat_round_trip(spark):
    kind = "conv_id long, turn long, role string, text string, piece string"
    rows = [(1, 2, "assistant", TRICKY, ""), (1, 1, "user", TRICKY + "\\", ""), (1, 3, "we: ird\n### x", "\\</turn>", ""), (2, None, None, None, ""), (2, 0, "assistant", None, ""), (None, 0, "assistant", "a: b </turn>\n### c", ""), (3, 0, "assistant", "same", ""), (3, 0, "assistant", "same", "")]
    given = spark.createDataFrame(rows, kind)
    formatted = chat.format_conversations(given)
    turns = {}
    for r in formatted.collect():
        turns.setdefault(r["conv_id"], []).extend(chat.turns_of(r["formatted"]))
        for a, b in zip(r["loss_starts"], r["loss_ends"]):
            assert chat.escaped(chat.unescaped(r["formatted"][a:b])) == r["formatted"][a:b]
    assert turns[1] == [("user", TRICKY + "\\"), ("assistant", TRICKY), ("we: ird\n### x", "\\</turn>")]
    assert turns[2] == [("", ""), ("assistant", "")] and turns[3] == [("assistant", "same")] * 2
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert back[1]["loss_chars"] == len(TRICKY) and back[3]["loss_chars"] == 8 and back[None]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(given.limit(0))).count() == 0


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    given = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "x" * 3_000) for k in range(800)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(given)
    assert formatted.count() > 1
    r = chat.read_back(formatted).first()
    assert r["n_turns"] == 800 and r["loss_chars"] == sum(len(f"turn {k} ") + 3_000 for k in range(1, 800, 2))


def test_pieces_leave_the_task_while_a_conversation_goes_on():
    compiled, sink, most = Template(chat.TEMPLATE, {"escaped": chat.escaped}), chat._Pieces(1), 0
    for _ in compiled.steps(sink, ({"role": "user", "text": "x" * 100_000} for _ in range(300))):
        most = max(most, sum(len(r[2]) for r in sink.rows) + sink.size)
        sink.rows.clear()
    assert sink.piece > 20 and most < 2 * chat.PIECE_CHARS


def test_bad_formats_are_refused():
    for bad in ("x", "### user", "### user: text", "### no role </turn>\n"):
        with pytest.raises(ValueError):
            list(chat.turns_of(bad))


def pages(spark):
    rows = [(k, f"http://h/{k}\r\nX: y", "<p>" + "word " * (k % 5 * 30) + "</p>", "q") for k in range(30)] + [(50, None, None, "q"), (51, "u", "", "q"), (None, "u", "é" * 9, "q"), (52, "u", "é" * 9, "q"), (53, "u", "z", "q"), (53, "u", "z", "q")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, error string")


def test_warc_round_trip(spark):
    given = pages(spark)
    source = given.collect()
    most = {}
    for r in source:
        if r["page_id"] is not None:
            most[r["html"] or ""] = max(most.get(r["html"] or "", -1), r["page_id"])
    want = sorted(str((r["page_id"], len((r["html"] or "").encode()), warc.sha1((r["html"] or "").encode()), *(("response", None) if r["page_id"] == most[r["html"] or ""] else ("revisit", most[r["html"] or ""])))) for r in source)
    got = warc.round_trip(given).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error").collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == want and all(r["error"] is None for r in got)
    assert warc.round_trip(given.limit(0)).count() == 0


def test_payloads_above_the_size_of_an_archive(spark):
    """One payload is larger than an archive is meant to be, and one task writes several archives."""
    rows = [(1, "a" * (warc.ARCHIVE_BYTES + 5)), (2, "b" * (warc.ARCHIVE_BYTES // 2)), (3, "c" * (warc.ARCHIVE_BYTES // 2 + 9)), (4, "d"), (5, "d"), (6, "e" * warc.ARCHIVE_BYTES)]
    given = spark.createDataFrame([(k, "u", t) for k, t in rows], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["refers_to"], r["error"]) for r in warc.round_trip(given).collect()}
    assert got == {k: (len(t), warc.sha1(t.encode()), 5 if k == 4 else None, None) for k, t in rows}


def test_small_payloads_are_not_revisited(spark):
    kinds = {(r["page_id"], r["record_type"]) for r in warc.round_trip(pages(spark), 5).filter("payload_bytes < 5").collect()}
    assert {k for _, k in kinds} == {"response"}


def test_broken_archives_give_errors(spark):
    records = [warc.record(k, "u", b"payload %d " % k * 50, False, None) for k in range(3)]
    whole = warc.archive(records, b"")
    assert list(warc.frames(whole)) == records
    assert isinstance(list(warc.frames(whole[:-3]))[-1], ValueError)
    assert isinstance(list(warc.frames(b"\x5d\x2a\x4d\x18\xff\x00\x00\x00ab"))[0], ValueError)
    good = records[0]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"payload 0", b"payload 9", 1), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    path = new_path(spark, "broken")
    import os

    os.makedirs(path.removeprefix("file://"))
    with open(path.removeprefix("file://") + "/part-0.warc.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(b"not a record") + whole)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 4 and [r["page_id"] for r in got][1:] == [0, 1, 2] and got[0]["error"]


def test_licenses(spark):
    filler = " ".join(f"word{k}" for k in range(60))
    mit = licenses.TEMPLATES["MIT"]
    rows = [
        (1, f"{filler}\nReleased under the MIT License. {filler}"), (2, f"{filler} released   under the mit license; {filler} Licensed under CC BY-NC 4.0. end"),
        (3, "the license plate of his car was lost without permission"), (4, None), (5, ""), (6, f"{filler} {mit.replace('free of charge', 'free of any charge')} {filler}"),
        (7, "Released under the BSD License."), (8, "This work is licensed under the GNU General Public License, version 3. All rights reserved."),
        (9, "Released under the MIT License. Released under the MIT License."),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"], r["license"], r["differing_words"]) for r in got)
    assert found == [(1, "MIT (notice)", 0), (2, "CC-BY-NC-4.0 (notice)", 0), (2, "MIT (notice)", 0), (6, "MIT", 1), (8, "All rights reserved", 0), (8, "GPL-3.0 (notice)", 0), (9, "MIT (notice)", 0), (9, "MIT (notice)", 0)]
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]].lower().split()[0] in ("released", "licensed", "this", "all", "permission") for r in got)


def plain_differences(template, words):
    """Least weighted edit distance between a template and any part of words, by the whole table."""
    weigh = lambda w: len(template) + 1 if w in licenses.NAMES else 1
    row = [0] * (len(words) + 1)
    for t in template:
        fresh = [row[0] + weigh(t)]
        for j, w in enumerate(words):
            fresh.append(min(row[j] + (0 if t == w else max(weigh(t), weigh(w))), row[j + 1] + weigh(t), fresh[j] + weigh(w)))
        row = fresh
    return row


def test_distances_equal_brute_force():
    r = random.Random(3)
    for name, text in licenses.TEMPLATES.items():
        template = licenses._words(text)
        for _ in range(3):
            w = list(template)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["other", "mit", "the", "words"])
            w = [r.choice(template) for _ in range(5)] + w + [r.choice(["under", "license", "x"]) for _ in range(5)]
            assert licenses.distances(template, w).tolist() == plain_differences(template, w), name


def altered(r, name):
    """A template's wording with as many changed words as it allows, none of them a name."""
    w = licenses.TEMPLATES[name].split()
    free = [k for k in range(1, len(w) - 1) if not any(x in licenses.NAMES for x in licenses._words(w[k]))]
    for k in r.sample(free, min(len(free), licenses.tolerance(licenses._words(licenses.TEMPLATES[name])))):
        w[k] = "zzword"
    return " ".join(w)


def test_every_notice_is_found_wherever_it_stands():
    r = random.Random(7)
    scanner, mention = licenses.Scanner(licenses.TEMPLATES), licenses.re.compile(licenses.MENTIONS, licenses.re.I)
    fill = lambda n: " ".join(words(r.randrange(10**6), n).split())
    exact = loose = 0
    for name, wording in licenses.TEMPLATES.items():
        for before, after in ((0, 0), (10, 0), (0, 10), (200, 200)):
            text = f"{fill(before)} {wording} {fill(after)}"
            got = scanner.text(text, mention)
            exact += any(g[2] == name and g[4] == 0 for g in got)
        got = scanner.text(f"{fill(30)} {altered(r, name)} {fill(30)}", mention)
        loose += any(g[2] == name for g in got)
    assert exact == 4 * len(licenses.TEMPLATES)
    assert loose >= 0.9 * len(licenses.TEMPLATES)
    many = "  ".join(f"{wording} {fill(3)}." for wording in licenses.TEMPLATES.values())
    assert sorted(g[2] for g in scanner.text(many, mention)) == sorted(licenses.TEMPLATES)
    assert [g[2] for g in scanner.text("Licensed under the MIT License. Licensed under the Apache License 2.0. All rights\u00a0reserved.", mention)] == ["MIT (notice)", "Apache-2.0 (notice)", "All rights reserved"]
    assert scanner.text("Licensed under the QRS License. the license of CC BY 5.0", mention) == []


def test_only_winners_of_the_compression_are_confirmed():
    """With dictionaries that know nothing, no template saves anything and none is found; with one that knows, that one alone is."""
    text, mention = "words before. Licensed under the BSD 3-Clause License. All rights reserved. words after", licenses.re.compile(licenses.MENTIONS, licenses.re.I)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert [g[2] for g in scanner.text(text, mention)] == ["BSD-3-Clause (notice)", "All rights reserved"]
    for knows in (set(), {"All rights reserved"}):
        blind = licenses.Scanner(licenses.TEMPLATES)
        blind.templates = [(name, w, given if name in knows else blind.plain, most) for name, w, given, most in blind.templates]
        assert {g[2] for g in blind.text(text, mention)} == knows


def test_scan_against_alignment_of_whole_texts():
    """Each template aligned with each whole text, without blocks or compression: the scan finds nothing else, and at least 19 of 20 of it."""
    r = random.Random(11)
    scanner, mention = licenses.Scanner(licenses.TEMPLATES), licenses.re.compile(licenses.MENTIONS, licenses.re.I)
    fill = lambda n: " ".join(words(r.randrange(10**6), n).split())
    found = there = 0
    for _ in range(60):
        names = r.sample(sorted(licenses.TEMPLATES), 3)
        text = " ".join(f"{fill(r.randrange(60))} {altered(r, n) if r.random() < 0.4 else licenses.TEMPLATES[n]}" for n in names) + f" {fill(20)}"
        own = [m.group().lower() for m in licenses._WORD.finditer(text)]
        ends = [m.end() for m in licenses._WORD.finditer(text)]
        plain = {(n, ends[e - 1]) for n, t in licenses.TEMPLATES.items() for e in np.flatnonzero(licenses.distances(licenses._words(t), own) <= licenses.tolerance(licenses._words(t))).tolist() if e}
        got = {(g[2], g[1]) for g in scanner.text(text, mention)}
        assert got <= plain
        apart = {n for n, _ in plain} & set(names)
        there, found = there + len(apart), found + len(apart & {n for n, _ in got})
    assert found >= 0.95 * there


@pytest.mark.parametrize("text,name", [
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later (SPDX)"), ("// SPDX-License-Identifier: LGPL-2.1-only */", "LGPL-2.1-only (SPDX)"), ("# SPDX-License-Identifier: ISC", "ISC (SPDX)"),
    ("This text is licensed under CC BY 4.0 by its author", "CC-BY-4.0 (short)"), ("The code is licensed under the BSD 3-Clause License.", "BSD-3-Clause (notice)"), ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007", "GPL-3.0 (title)"),
    ("MIT License\n\nCopyright (c) 2020 Someone", "MIT (title)"), ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "MIT (disclaimer)"),
])
def test_common_wordings(text, name):
    scanner, mention = licenses.Scanner(licenses.TEMPLATES), licenses.re.compile(licenses.MENTIONS, licenses.re.I)
    assert name in [g[2] for g in scanner.text(text, mention)]


def test_license_rows(spark, docs, empty):
    kind = "doc_id long, text string, license string"
    rows = [(1, "All rights\u00a0reserved."), (None, "Released under the MIT License."), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (3, "word " * 300_000 + "All rights reserved."), (4, None), (5, "")]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in rows], kind)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "3", "None"]
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs).count() == 0


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network({"a": 1}, np.array([5]), seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, mask, y = r.standard_normal((3, 6, 6 * toxicity.HIDDEN)), np.array([[1] * 6, [1] * 4 + [0] * 2, [1] + [0] * 5], bool), np.array([1.0, 0.0, 1.0])
    _, g, d_x = net.gradients(x, mask, y)
    loss = lambda: net.gradients(x, mask, y)[0]
    for name, grad in [(k, v) for k, v in g.items()] + [("x", d_x)]:
        held = x if name == "x" else net.p[name]
        for at in r.integers(0, held.size, 6):
            i = np.unravel_index(at, held.shape)
            old = held[i]
            held[i] = old + 1e-4
            up = loss()
            held[i] = old - 1e-4
            down = loss()
            held[i] = old
            assert abs((up - down) / 2e-4 - grad[i]) < 1e-3


def test_both_forward_passes_agree():
    net = toxicity.Network({"a": 1}, np.array([5]), seed=3)
    table = np.concatenate([np.zeros((1, 6 * toxicity.HIDDEN)), np.random.default_rng(1).standard_normal((9, 6 * toxicity.HIDDEN))]).astype(np.float32)
    rows = np.array([[1, 2, 3, 4], [5, 6, 0, 0], [9, 0, 0, 0]])
    assert np.allclose(net.logits(table, rows), net.forward(table[rows], rows > 0)[0], atol=1e-4)


def corpus(n=900):
    r = random.Random(4)
    calm = [r.choice("aeiou") + r.choice("bdfgkl") + r.choice("aeiou") + r.choice("mnrst") for _ in range(200)]
    out = []
    for k in range(n):
        w = [r.choice(calm) for _ in range(r.randint(30, 200))]
        if k % 3 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), "zork" + r.choice(calm))  # a stem with endings that are new each time
        out.append((k, " ".join(w), int(k % 3 == 0)))
    return out


def test_toxicity_finds_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(9900, None, "x"), (9901, "", "x"), (9902, "!!", "x"), (None, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scores(docs, labels).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in rows)
    held = [(got[k]["score"], y) for k, _, y in rows if got[k]["held_out"]]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) > 0.97 * len(ones) * len(zeros)
    assert sum(s >= 0.7 for s in ones) > 0.9 * len(ones) and sum(s >= 0.7 for s in zeros) < 0.05 * len(zeros)
    assert got[9900]["score"] == got[9901]["score"] == got[9902]["score"] == 0 and got[None]["score"] == got[0]["score"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert {r["score"] for r in toxicity.scores(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_long_texts_are_scored_in_all_windows():
    net = toxicity.train([t for _, t, _ in corpus()], [y for _, _, y in corpus()], 0.33)
    calm = " ".join(["abem"] * 90_000)
    low, high = toxicity.Scorer(net).scores([calm, calm + " zorkabem zorkidon"])
    assert high > 0.7 > low


def plain_score(net, text):
    """The score of a text window by window and word by word, from the equations."""
    import re

    words = re.findall(r"\w+", text.lower())
    h, sigmoid = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    number = {tuple(t): i + 1 for i, t in enumerate((k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF) for k in map(int, net.trigrams))}

    def embedded(word):
        marked = [ord(c) for c in f"^{word}$"]
        parts = [net.p["trigram"][number.get(tuple(marked[i : i + 3]), 0)] for i in range(len(word))]
        return np.concatenate([net.p["word"][net.words.get(word, 0)], np.mean(parts, axis=0)]) @ net.p["in"] + net.p["in_bias"]

    def read(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            x, back = x[3 * h * way : 3 * h * (way + 1)], state @ net.p["back"][way]
            z, r = sigmoid(x[:h] + back[:h]), sigmoid(x[h : 2 * h] + back[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * back[2 * h :])
            out.append(state)
        return out

    best = -np.inf
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        xs = [embedded(w) for w in words[start : start + toxicity.WINDOW]]
        both = np.concatenate([read(xs, 0), read(xs[::-1], 1)[::-1]], axis=1)
        weights = np.exp(both @ net.p["attend"])
        best = max(best, weights @ (both @ net.p["out"]) / weights.sum() + net.p["out_bias"][0])
    return sigmoid(net.scale * best + net.shift)


def test_scores_are_those_of_the_plain_equations():
    rows = corpus(240)
    net = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], 0.33)
    texts = [t for _, t, _ in rows[:12]] + ["one", "Zork, zork!", " ".join(["abem"] * 32), " ".join(["ebid"] * 33), " ".join(["ebid"] * 48), " ".join(["ebid"] * 49 + ["zorkabem"])]
    assert np.allclose(toxicity.Scorer(net).scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_folds_keep_copies_together_and_share_out_each_label():
    said, y = [["a"], ["b"], ["a"], ["c"], ["d"], ["e"], ["a"]], np.array([1, 1, 1, 0, 0, 0, 1], np.float32)
    fold = toxicity._folds(said, y)
    assert fold[0] == fold[2] == fold[6] != fold[1] and set(fold[3:6]) == set(range(toxicity.FOLDS))
