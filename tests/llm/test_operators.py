"""Each operator against a brute-force version, on sf0.001 and on odd rows, and on empty tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stowage.llm import bpe, chat, html_extract, media, minhash_dedup, mixing, quality, secrets, suffix_dedup, toxicity
from stowage.llm.common import connected_components, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(params=["table", "odd"])
def docs(request, spark, sf_dir, odd_docs):
    return odd_docs if request.param == "odd" else read(spark, sf_dir, "documents")


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple(str(x) for x in r))


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality(docs):
    got = quality.quality_verdicts(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted((t.doc_id, *brute_quality(t.text)) for t in texts)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in got)


def test_quality_hosts(spark, no_docs):
    bad, good = "w " * 10, " ".join(f"word{i}" for i in range(80))
    rows_ = [(i, bad if i % 10 else good, "bad") for i in range(300)] + [(1000 + i, good if i % 20 else bad, f"g{i % 9}") for i in range(900)] + [(5000, good, "new")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_verdicts(df).collect()}
    assert not got[0].kept and got[0].host_rejected and got[1001].kept and got[5000].kept
    quality_limit, quality.BROADCAST_HOSTS = quality.BROADCAST_HOSTS, 0
    try:
        assert {r.doc_id: r.kept for r in quality.quality_verdicts(df).collect()} == {k: r.kept for k, r in got.items()}
    finally:
        quality.BROADCAST_HOSTS = quality_limit
    assert quality.quality_verdicts(no_docs).collect() == []


def test_clause_weights():
    g = toxicity.Grammar({"=fool": 3.0, "^idio": 2.0})
    weight = lambda text: round(sum(w for c in g.clauses(text)[1] for _, _, w in c), 6)
    paths = lambda text: [p for c in g.clauses(text)[1] for _, p, _ in c]
    assert paths("what a fool. nothing") == ["insult"] and weight("what a fool") == 3
    assert paths("you are a fool") == paths("fool that you are") == ["insult+target"] and weight("you are a fool") == 4.5
    assert paths("this is not a fool") == ["insult+negated"] and weight("this is not a fool") == 0.9
    assert paths("he said the fool") == ["insult+reported+target"] and weight("he said the fool") == 1.8
    assert paths("it was said fool") == ["insult+reported"] and weight("it was said fool") == 1.2
    assert paths("it was never said by a fool") == ["insult+reported"] and weight("it was said fool") == 1.2
    assert paths("it was said and is not a fool") == ["insult+negated+reported"]
    assert paths('the word " idiots " there, idiots') == ["insult+reported", "insult"]
    assert paths("we will kill you") == ["threat+target"] and paths("to kill time") == ["threat"]
    assert g.clauses("") == (0, []) and paths("nothing here") == []
    assert weight("not you fool. fool") == weight("fool") + weight("not you fool")


def test_composition_is_the_parts_in_turn():
    """The one transducer writes and weighs what its parts do one after another, on every short clause and many long ones."""
    import random

    rng = random.Random(4)
    clauses = [c for n in range(4) for c in itertools.product(toxicity.TAGS, repeat=n)] + [rng.choices(toxicity.TAGS, k=rng.randint(4, 40)) for _ in range(3000)]
    for tags in clauses:
        first = toxicity.NEGATION.run(list(tags))
        second = toxicity.REPORT.run([t for t, _ in first])
        third = toxicity.TARGET.run([t for t, _ in second])
        got = toxicity.CLAUSE.run(list(tags))
        assert [t for t, _ in got] == [t for t, _ in third]
        assert all(abs(w - sum(p[i][1] for p in (first, second, third))) < 1e-12 for i, (_, w) in enumerate(got))
        # And by plain rules for each cue, without transducers.
        want = []
        used = open_cue = None
        quoted = said = False
        negated = aimed = -100
        for i, t in enumerate(tags):
            if t == "neg":
                negated = i
            elif t == "quote" and not said:
                quoted = not quoted
            elif t == "report" and not quoted:
                said = True
            elif t == "target":
                if open_cue is not None and i - open_cue <= 4:
                    want[-1] *= 1.5
                aimed, open_cue = i, None
            elif t in ("insult", "threat"):
                w = (0.3 if i - negated <= 3 else 1) * (0.4 if said or quoted else 1) * (1.5 if i - aimed <= 4 else 1)
                open_cue = None if i - aimed <= 4 else i
                negated = aimed = -100
                want.append(w)
        got = [w for _, _, w in toxicity.clause_paths(list(tags), [1.0] * len(tags))]
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (tags, got, want)


def test_toxicity(spark, no_docs, odd_docs):
    big = "/root/testdata/sf0.1"
    docs, labels = read(spark, big, "documents"), read(spark, big, "labels")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    pairs = [(got[x.doc_id].predicted, x.toxic) for x in labels.collect() if got[x.doc_id].held_out]
    hit = sum(p and y for p, y in pairs)
    assert hit >= 0.9 * sum(y for _, y in pairs) and hit >= 0.95 * sum(p for p, _ in pairs)
    # One insult counts most when aimed, less when reported, least when negated.
    word = max((k for k in model.lexicon if k[0] == "="), key=model.lexicon.get)[1:]
    ways = [f"you are a {word} and so on", f"this is a {word} and so on", f"it was said a {word} and so on", f"this is not a {word} and so on", "this is a thing and so on"]
    scores = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(ways)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert scores == sorted(scores, reverse=True) and scores[0] > scores[3]
    assert len(toxicity.score(odd_docs, model).collect()) == odd_docs.count()
    assert toxicity.score(no_docs, model).collect() == []
    none = toxicity.fit(no_docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd_docs, none).collect()} == {0}
    kept = {r.doc_id for r in toxicity.split_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def brute_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(docs, no_docs):
    got = secrets.scan(docs)
    for r, t in zip(rows(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")), rows(docs.select("doc_id", "text"))):
        want = brute_secrets(t.text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(line) and set(line.split(",")) <= set(r.spans.split(",")) | {""}
    assert secrets.scan(no_docs).collect() == []


def test_random_strings(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    ratios = secrets.fit(secrets.labelled_samples(docs))
    text = "see k9X2mQ7vR4tL8pW3zN6bY1cD5fG0hJ but not thereandheresomeofthemorning2 or user_account_identifier_3, password: swordfish1"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan(df, ratios).collect()} == {1: "random:4:34,assign:105:125".replace("105:125", f"{text.index('password')}:{len(text)}"), 2: ""}
    assert {r.text for r in secrets.redact(df, ratios).collect()} == {text[:4] + "[secret]" + text[34 : text.index("password")] + "[secret]", None}


def test_redact_keeps_rows(odd_docs):
    out = secrets.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    for a, b in zip(rows(out.select("doc_id", "text")), rows(odd_docs.select("doc_id", "text"))):
        assert a.text == b.text or "[secret]" in a.text


def brute_sets(texts):
    out = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(docs, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    sets = brute_sets((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = minhash_dedup.near_duplicates(docs).collect()
    assert sorted({(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}) == [(i, len(sets[i]), top(i), top(i) == i) for i in sorted(sets)]
    assert len(got) == docs.count()


def test_near_duplicates_large_group(spark, no_docs, monkeypatch):
    """Copies with one and with many edits around one text, in blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    words = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(f"x{i}" if j in {(i * 7) % 120, (i * 13 + i % 3 * 40) % 120} or (i % 4 == 3 and j % 11 == 3) else w for j, w in enumerate(words))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    test_near_duplicates.__wrapped__(df, 8, monkeypatch) if hasattr(test_near_duplicates, "__wrapped__") else test_near_duplicates(df, 8, monkeypatch)
    assert minhash_dedup.near_duplicates(no_docs).collect() == []


def test_collisions_decide(spark, monkeypatch):
    """Pairs with fewer collisions than the threshold are never confirmed, however similar; the count itself is brute force's."""
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 3, (n, minhash_dedup.COORDINATES)).astype(np.int64) for n in (7, 5))
    assert minhash_dedup.collisions(a, b).tolist() == [[sum(x == y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
    words = [f"v{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join("x" if i in (50, 100, 150) else w for i, w in enumerate(words)))], "doc_id long, text string")
    assert [r.component_id for r in minhash_dedup.near_duplicates(df).collect()] == [1, 1]
    monkeypatch.setattr(minhash_dedup, "matches", lambda percent: minhash_dedup.COORDINATES)
    assert sorted(r.component_id for r in minhash_dedup.near_duplicates(df).collect()) == [1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 200), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, **{1000 + i: 1000 for i in range(50)}}


def test_bpe(docs, no_docs):
    ranks = bpe.codec(VOCABULARY, PATTERN).encoding
    texts = docs.select("doc_id", "text").collect()
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (64, 32)):
        got = rows(bpe.encode_digests(docs, VOCABULARY, PATTERN, chunk, overlap))
        want = []
        for t in texts:
            ids = ranks.encode_ordinary(t.text or "")
            want.append((t.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.text or "")))
        assert [tuple(r) for r in got] == sorted(want, key=lambda r: tuple(map(str, r)))
    assert bpe.encode_digests(no_docs, VOCABULARY, PATTERN).collect() == []
    back = bpe.decode_ids(bpe.encode_ids(docs, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back.collect()) == sorted((t.doc_id, (t.text or "").encode()) for t in texts)


def conversations(spark, sf_dir):
    odd = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "system", "be <|kind|>"), (-8, None, "assistant", None), (-9, 3, None, "x &amp; y"), (-9, 3, None, "x &amp; y")]
    odd += [(-10, i, "system" if i in (0, 5) else "assistant" if i % 2 else "user", f"turn {i} " + "word " * (i % 50)) for i in range(700)]
    return read(spark, sf_dir, "conversations").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))


def brute_windows(turns, size, budget, history):
    """(first own turn, turns before it that are repeated, own turns) of each window, by the stated rules; size(i) are a turn's tokens."""
    system = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
    out = []
    for i in range(len(turns)):
        if i % chat.STRETCH and out and used + size(i) <= budget:
            out[-1][2].append(i)
            used += size(i)
            continue
        used = size(i) + (size(system) if system is not None and system < i else 0)
        past, spent = i, 0
        while past > max(0, i - history):
            more = 0 if past - 1 == system else size(past - 1)
            if spent + more > max(0, min(budget // 4, budget - used)):
                break
            past, spent = past - 1, spent + more
        used += spent
        before = ([system] if system is not None and system < i else []) + [j for j in range(past, i) if j != system]
        out.append((i, before, [i]))
    return out


@pytest.mark.parametrize("budget, history", [(chat.BUDGET, chat.HISTORY), (120, 2), (120, 3), (40, 0)])
def test_chat(spark, sf_dir, budget, history):
    df = conversations(spark, sf_dir)
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((-(1 << 62) if r.turn is None else r.turn, r.role or "", r.text or ""))
    windows = chat.windows(df, VOCABULARY, PATTERN, budget, history)
    got = {r.conv_id: r for r in chat.window_digests(windows).collect()}
    assert got.keys() == by.keys()
    formatted = defaultdict(list)
    for r in windows.collect():
        formatted[r.conv_id].append(r)
    count = lambda text: len(bpe.codec(VOCABULARY, PATTERN).encoding.encode_ordinary(text))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        pieces = [f"<|{esc(r)}|>{esc(t)}</s>\n" for _, r, t in turns]
        sizes = [count(p) for p in pieces]
        want = brute_windows(turns, sizes.__getitem__, budget - count("<s>"), history)
        for w, (first, before, own) in zip(sorted(formatted[c], key=lambda w: w.window), want, strict=True):
            assert (w.window, w.n_context, w.formatted) == (first, len(before), "<s>" + "".join(pieces[i] for i in before + own))
            assert w.n_tokens == count("<s>") + sum(sizes[i] for i in before + own)
            assert w.n_tokens <= budget or len(own) == 1
            masked = [chat.unescape(w.formatted[s.a : s.b]) for s in w.loss]
            assert masked == [turns[i][2] for i in own if turns[i][1] == "assistant"]
    assert chat.window_digests(chat.windows(df.limit(0), VOCABULARY, PATTERN)).collect() == []


def esc(text):
    for bare, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lsq;"), ("]", "&rsq;"), ("|", "&bar;")):
        text = text.replace(bare, reference)
    return text


def test_given_conversations_are_split(spark):
    """At the query's budget many conversations have several windows, and some repeat an assistant's turn, masked."""
    rows_ = chat.windows(read(spark, "/root/testdata/sf0.01", "conversations"), VOCABULARY, PATTERN).collect()
    later = [r for r in rows_ if r.window]
    assert len(later) > 20 and any("<|assistant|>" in r.formatted[: r.loss[0].a if r.loss else None].rsplit("<|assistant|>", 1)[0] for r in later if r.n_context)


def test_repeats(docs, no_docs, monkeypatch):
    for hot in (suffix_dedup.HOT, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        texts = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
        seen = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
        want = []
        for i, b in texts:
            gone = bytearray(len(b))
            for j in range(len(b) - 199):
                if seen[b[j : j + 200]] > 1:
                    gone[j : j + 200] = b"\1" * 200
            want.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), sha(bytes(x for x, y in zip(b, gone) if not y))))
        assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == sorted(want)
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def test_loser_tree():
    import random

    rng = random.Random(3)
    items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))), b"l", [(i, -i, i)]) for i in range(400))
    runs = [suffix_dedup.encode_run(items[k::7]) for k in range(7)] + [b""]
    merged = list(suffix_dedup.merge_runs(runs))
    assert sorted((s, left, p) for _, s, left, p in merged) == items and [m[1] for m in merged] == [x[0] for x in items]
    for a, b in itertools.pairwise(merged):
        n = next((k for k, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
        assert b[0] == n


def test_mixing(spark, docs, no_docs):
    got = mixing.mixed(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert mixing.mixed(no_docs).collect() == []


@pytest.mark.parametrize("targets", [{"a": 0.9, "b": 0.02, "c": 0.03, "d": 0.05}, {"a": 1, "b": 1, "c": 1, "d": 1}, None])
def test_mix_is_fair(spark, targets):
    n = {"a": 900, "b": 333, "c": 120, "d": 50}
    df = spark.createDataFrame([(i, s) for s in n for i in range(n[s])], "doc_id long, source string")
    shares = {r.source: r.share for r in mixing.source_shares(df, targets=targets).collect()}
    plan = sorted(mixing.schedule(mixing.source_shares(df, targets=targets), 10_000, 1).collect(), key=lambda r: r.slot)
    assert [r.slot for r in plan] == list(range(sum(n.values())))
    over = {s: n[s] / shares[s] for s in n}
    done, v = Counter(), 0.0
    for r in plan:
        assert r.block == done[r.source]
        done[r.source] += 1
        left = 1.0  # one slot of fluid time
        while left > 1e-12:
            live = [s for s in n if over[s] > v + 1e-9]
            pace = sum(shares[s] for s in live)
            step = min(left / pace, min(over[s] for s in live) - v) if live else 0
            v += step
            left -= step * pace if live else left
        assert all(abs(done[s] - shares[s] * min(v, over[s])) < 1 + 1e-6 for s in n)


def test_mix_order(odd_docs, no_docs):
    out = mixing.in_mix_order(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert mixing.in_mix_order(no_docs).collect() == []


def test_media(docs, no_docs):
    got = rows(media.media_columns(docs))
    for r, t in zip(got, rows(docs.select("doc_id", "text"))):
        raw = (t.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.kind) == (t.doc_id, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]), "wav")
        assert r.media_sha256 == sha(media.to_wav(payload)) and r.media_bytes == len(payload) + 44
    assert media.media_columns(no_docs).collect() == []


def test_carving():
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b"
    payload = b"RIFF no object BM GIF89a " + png + b"...." + gif
    wav = media.to_wav(payload)  # of odd length, so a pad byte follows the data
    objects = media.carve(wav)
    assert [(k, wav[a:b]) for k, a, b in objects] == [("wav", wav), ("png", png), ("gif", gif)]
    assert media.carve(wav[:-1])[0][0] != "wav" and media.carve(png[:-2]) == [] and media.carve(b"") == []
    assert len(payload) % 2 and media.wav_samples(wav) == payload


def test_sniffing_corrects_types(spark):
    df = spark.createDataFrame([(1, 0, None, None), (2, 3, bytearray(b"abc"), "image/png"), (3, 1, bytearray(media.to_wav(b"x" * 64)), "image/png")], "doc_id long, n_bytes long, media binary, declared string")
    got = {r.doc_id: r for r in media.sniff_media(df).collect()}
    assert got[1].kind == got[2].kind == "unknown" and got[3].feature.startswith("type=audio/wav;was=image/png")


PAGE = """<!DOCTYPE html><html><head><title>No&amp;</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<!-- c --><div class="ad">buy</div><{tag}><h1>Head&nbsp;line &amp;c</h1><p><b>First {i}<br>part.<br><p>Second &eacute;   part, with   text.
<form>ask<input></form><aside>side</aside><div class="comments"><article class="comment"><p>reader says a lot of things here</p></article></div></{close}><footer>&copy; f</footer>"""


def test_html(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    for r, p in zip(rows(html_extract.main_text(pages)), rows(pages.select("page_id", "url", "html"))):
        body = re.search(r"(?s)<article>(.*)</article>", p.html)[1]
        import html as h

        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert (r.page_id, r.url, r.text, r.n_chars) == (p.page_id, p.url, want, len(want))


def test_html_odd_pages(spark):
    want = "Head line &c\nFirst {i} part.\nSecond é part, with text."
    rows_ = [(i, f"http://h{i % 2}.example/x", PAGE.format(i=i, tag="article" if i % 2 else 'div class="story-12 post"', close="article" if i % 2 else "div")) for i in range(8)]
    rows_ += [(90, None, None), (91, "http://h0.example/", ""), (92, "nonsense", "just text &lt; here"), (93, "http://h1.example/", "<p>cut <scr"), (94, "http://h1.example/", "<script>x"), (0, "http://h0.example/x", rows_[0][2])]
    got = html_extract.main_text(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows_) and all(texts[i] == want.format(i=i) for i in range(8))
    assert (texts[90], texts[91], texts[92], texts[93], texts[94]) == ("", "", "just text < here", "cut", "")
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hosts(spark):
    urls = ["http://User@WWW.a.example:80/p?x=//b", "//c.example#f", "ftp://d", "e.example/x", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(html_extract.host_of(F.col("url"))).collect()] == ["www.a.example", "c.example", "d", "", "", ""]
