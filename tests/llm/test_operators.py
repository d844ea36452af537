"""Each corpus operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from labelwright.llm import base, bpe, catalog, components, fingerprint, hamming, langid, near_dedup, oracles, packing, pii, quality, suffix_dedup, toxicity

from ..oracle import compared, connection

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "A b"), (5, "A b"), (6, "ü" * 3000), (None, "a b c")]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("rep", F.lit(1)).withColumn("z", F.lit("x")).withColumn("key", F.lit(2)) if extra else df


def words(rng, n, of="ab cd ef gh ij kl mn op qr st uv wx yz".split()):
    return " ".join(rng.choice(of) for _ in range(n))


@pytest.mark.parametrize("name", ["op3_near_dedup", "op8_hamming"])
def test_same_as_sql(spark, name):
    got, want = compared(spark, connection(SF), catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert got == want


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    first = [rng.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(70):  # copies with edits of their own, on both sides of the threshold
        own = list(first)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rows += [(100 + i, words(rng, rng.randint(0, 12), vocabulary[:6])) for i in range(30)] + [(200, rows[3][1]), (201, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd(spark):
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, ODD)).collect())
    assert found == {(1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 1, 4, True): 1, (5, 1, 4, False): 2, (6, 1, 6, True): 1, (None, 1, None, True): 1}
    assert near_dedup.near_duplicates(table(spark, ODD).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 60), (60, 50), (70, 70)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}


def test_without_ids(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(100), None, 3]], "doc_id long")
    gone = spark.createDataFrame([(i,) for i in range(0, 100, 3)], "x long")
    left = sorted(r[0] for r in base.without_ids(rows, gone).where("doc_id IS NOT NULL").collect())
    assert left == [i for i in range(100) if i % 3]
    assert base.without_ids(rows, gone.limit(0)).count() == 102


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:200], rng.integers(0, 1 << 63, 100, dtype=np.uint64))))
    x, y = (near_dedup.sketch(s, np.array([0, len(s)]), 512)[0] for s in (a, b))
    assert not (x == near_dedup.UNSET).any()
    assert abs((x == y).mean() - 200 / 400) < 0.1
    one = near_dedup.sketch(a[:1], np.array([0, 1]), 64)
    assert not (one == near_dedup.UNSET).any()


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(t, gone) if not g), len(re.findall(b"\1+", gone))))
    return out


@pytest.mark.parametrize("hot", [2, 5000])
def test_repeats(spark, hot):
    rng = random.Random(hot)
    shared = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 60))) for _ in range(6)]
    texts = ["".join(rng.choice(shared)[rng.randint(0, 9) :] if rng.random() < 0.5 else words(rng, 4) for _ in range(rng.randint(0, 6))) for _ in range(50)]
    texts += ["abab" * 30, None, "", texts[4]]
    out = suffix_dedup.without_repeats(table(spark, list(enumerate(texts))), length=20, gram=6, hot=hot).collect()
    want = brute_repeats([(t or "").encode() for t in texts], 20)
    assert {r.doc_id: (bytes(r.kept), len(r.spans)) for r in out} == dict(enumerate(want))


def test_repeat_groups_have_all_occurrences(spark):
    passage = "the quick brown fox jumps over it"
    docs = table(spark, [(i, f"{'xyz'[i] * 9}{passage}{'uvw'[i] * 9}") for i in range(3)], False)
    found = collections.defaultdict(set)
    for r in suffix_dedup.repeated(docs, length=20, gram=6).collect():
        found[r.repeat].add((r.doc_id, r.start, r.size))
    covered = set()
    for group in found.values():
        assert {i for i, _, _ in group} == {0, 1, 2} and len({(a, n) for _, a, n in group}) == 1
        covered |= {b for _, a, n in group for b in range(a, a + n)}
    assert covered == set(range(9, 9 + len(passage)))


def test_repeats_odd(spark):
    out = suffix_dedup.without_repeats(table(spark, [*ODD, (7, "é" * 150 + "a"), (8, "è" * 150)]), carry=("rep",), as_text=True).collect()
    assert len(out) == len(ODD) + 1 and all(r.rep == 1 for r in out)
    assert {r.doc_id: r.kept for r in out if r.doc_id in (1, 2, 5, 6)} == {1: "", 2: "", 5: "A b", 6: ""}
    assert suffix_dedup.without_repeats(table(spark, ODD).limit(0)).count() == 0


def test_bpe_is_the_library_s(spark):
    from tokenizers import Tokenizer

    path = catalog.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = [*"ab \n\t é　中字1２'sS.<|>!\x1c\x85​😀", "<|endoftext|>", "  ", "'ll", " the", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " " * 300, "ab" * 2000]
    out = bpe.decoded(bpe.encoded(table(spark, [*enumerate(texts), (None, None)]), path), path).collect()
    want = {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    assert {r.doc_id: list(r.ids) for r in out} == {**want, None: []}
    assert all(r.decoded == (texts[r.doc_id] if r.doc_id is not None else "") and r.rep == 1 for r in out)
    bad = spark.createDataFrame([([library.encode("é").ids[0], 50256],), (None,)], "ids array<int>")
    assert bpe.decoded(bad, path).collect()[0].decoded == library.decode(library.encode("é").ids[:1] + [50256], skip_special_tokens=False)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = catalog.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = [*"ab \n\t é　中字1２'sS.<|>!\x1c\x85ΣİI", "<|endoftext|>", "<|startoftext|>", "é", "'ll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(300)] + [None, "", "many words " * 5000]
    pieces = packing.pieces(table(spark, list(enumerate(texts))), path)
    for per_task in (100_000, 40):
        rows = packing.packed(pieces, per_task=per_task).collect()
        ids, held = collections.defaultdict(dict), collections.defaultdict(list)
        for r in rows:
            ids[r.doc_id][r.piece] = (r.start, list(np.frombuffer(bytes(r.ids), "<u4")))
            held[r.sequence_id].append((r.offset, r.length))
        for i, text in enumerate(texts):
            own = [x for k in sorted(ids[i]) for x in ids[i][k][1]]
            assert own == [*library.encode(text or "", add_special_tokens=False).ids, 1]
            assert [ids[i][k][0] for k in sorted(ids[i])] == list(range(0, len(own), 4096))
        for places in held.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        total = sum(r.length for r in rows)
        assert len(held) <= -(-total // 4096) + 2
    assert packing.packed(pieces.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [(1, "hello world " * 30), (2, None), (4, "x"), (7, "hello world " * 30), (9, ""), (11, "some other text, quite unlike the others " * 9), (None, "gone")]
    out = {r.doc_id: r for r in fingerprint.compared(table(spark, rows)).collect()}
    own = sorted((i, t or "") for i, t in rows if i is not None)
    for (i, text), (_, then) in zip(own, own[1:] + own[:1]):
        half = len(text) // 2
        assert out[i].n_chars == len(text)
        assert out[i].edited == text[: len(text) - half] + then[:half]
        prints = fingerprint.written_out(fingerprint.minima([text, out[i].edited, then]))
        assert (out[i].fingerprint, out[i].edited_fingerprint) == tuple(prints[:2])
        assert out[i].near_edited == fingerprint.likeness(*prints[:2]) and out[i].near_next == fingerprint.likeness(prints[0], prints[2])
    assert len(out) == 6 and out[1].fingerprint == out[7].fingerprint
    assert fingerprint.compared(table(spark, rows).limit(0)).count() == 0
    assert fingerprint.compared(table(spark, rows[:1])).first().near_next == 1.0


def test_parsing_is_locally_consistent():
    rng = random.Random(5)
    texts = [words(rng, 300) for _ in range(20)]
    a, b, c = (fingerprint.minima([p + t for t in texts]) for p in ("", "zz q", "another start of some length. "))
    assert (a == b).mean() > 0.8 and (a == c).mean() > 0.8
    assert (a[:-1] == a[1:]).mean() < 0.3


def brute_phrases(text):
    """Hashed names of each level by a loop over a text's symbols, as the module's docstring says."""
    word, mixes = (1 << 64) - 1, lambda x: int(base.mixed(np.array([x], np.uint64))[0])
    names, levels = [mixes(ord(c) + 1) for c in text], []
    for _ in range(fingerprint.LEVELS[-1]):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        symbols = [x if n == 1 else mixes((x + n * int(base.MIX_A)) & word) for x, n in runs]
        labels = symbols
        for _ in range(4):
            low = [a ^ b for a, b in zip(labels, labels[1:])]
            places = [((d & -d).bit_length() - 1) for d in low]
            labels = [labels[0] & 1] + [2 * i + (x >> i & 1) for i, x in zip(places, labels[1:])]
        starts = [0]
        for i in range(2, len(labels)):
            if labels[i] > labels[i - 1] and (i + 1 == len(labels) or labels[i] > labels[i + 1]):
                starts.append(i)
        names = []
        for a, b in zip(starts, [*starts[1:], len(symbols)]):
            total = sum(mixes(x) * int(fingerprint._steps[j & 4095]) for j, x in enumerate(symbols[a:b]))
            names.append(mixes((total + (b - a) * int(base.MIX_B)) & word))
        levels.append(names)
    return [levels[i - 1] for i in fingerprint.LEVELS]


def test_fingerprints_are_a_plain_loop_s():
    rng = random.Random(14)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(25)] + ["x", "aaaa", "ab" * 40, "é" * 9 + "ü", "中文 abc"]
    got = fingerprint.minima([*texts, ""])
    for text, row in zip(texts, got):
        want = [min((n ^ int(seed)) * int(base.MIX_A) & ((1 << 64) - 1) for n in names) for names in brute_phrases(text) for seed in fingerprint.SEEDS]
        assert row.tolist() == (base.mixed(np.array(want, np.uint64)) >> np.uint64(48)).tolist()


def test_fingerprints_of_texts_longer_than_a_batch(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, n)) for i, n in ((1, 20), (2, 250_000), (3, 200_000), (4, 5))]
    assert len(rows[1][1]) > fingerprint.BATCH_CHARS
    out = {r.doc_id: r for r in fingerprint.compared(table(spark, rows)).collect()}
    for (i, text), (_, then) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        assert out[i].edited == text[: len(text) - half] + then[:half]
        assert out[i].fingerprint == fingerprint.written_out(fingerprint.minima([text]))[0]


def test_long_unrelated_texts_are_unlike():
    rng = np.random.default_rng(9)
    a, b = ("".join(map(chr, rng.integers(97, 123, 1 << 20))) for _ in range(2))
    x, y, z = fingerprint.minima([a, b, ""])
    assert (x == y).mean() < 0.05 and (x == z).mean() < 0.05
    assert (x == fingerprint.minima([a[: len(a) // 2] + b[len(b) // 2 :]])[0]).mean() > 0.2


def test_langid(spark):
    docs = base.documents(spark, SF)
    model = langid.trained(docs.where(~catalog.held_out()))
    assert len(model) == docs.select("lang").distinct().count() and all(len(d) <= langid.DICTIONARY_BYTES for _, d, _ in model)
    out = langid.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(catalog.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    odd = {r.doc_id: r for r in langid.identified(table(spark, [*ODD, (8, "123 !?")]), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].rejected and odd[i].score == 0 for i in (1, 2, 3, 8))
    assert odd[6].lang_pred != "und" and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identified(docs, []).where("lang_pred <> 'und'").count() == 0
    assert langid.trained(docs.limit(0)) == []


def brute_language(model, text):
    """(language, margin in bytes) by compressing the lower-cased text with each dictionary in turn."""
    sizes = []
    for lang, words_, n in model:
        d = zstandard.ZstdCompressionDict(words_, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((len(c.compress(text.lower().encode())), -n, lang))
    sizes.sort()
    return sizes[0][2], sizes[1][0] - sizes[0][0]


def test_langid_is_a_plain_loop_s(spark):
    docs = base.documents(spark, SF)
    model = langid.trained(docs.where(~catalog.held_out()))
    rows = [(i, r.text) for i, r in enumerate(docs.limit(40).collect())] + [(100, "der die das " * 40_000), (101, "x")]
    for r in langid.identified(table(spark, rows), model).collect():
        text = dict(rows)[r.doc_id]
        lang, gap = brute_language(model, text)
        size = len(text.lower().encode())
        assert r.lang_pred == lang and abs(r.margin * size - gap) < 1e-6 and r.rejected == (gap / size < langid.NARROW)


def test_langid_rejects_junk_more_than_text(spark):
    docs = base.documents(spark, SF)
    model = langid.trained(docs.where(~catalog.held_out()))
    rng = random.Random(16)
    junk = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(rng.randint(100, 800)))) for i in range(60)]
    assert langid.identified(table(spark, junk), model).where("rejected").count() > 30
    assert langid.identified(docs, model).where("rejected").count() < 0.1 * docs.count()


def test_toxicity(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30) + (f". you {rng.choice(['zorbish', 'zorbed', 'grumpf'])} {words(rng, 3)}." if i % 4 == 0 else "."), int(i % 4 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.trained(labelled.where("doc_id < 300"))
    out = toxicity.scored(labelled.where("doc_id >= 300"), model).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out)
    odd = toxicity.scored(table(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.3 and r.predicted == 0 for r in odd)
    assert toxicity.trained(labelled.limit(0))[0] == {}


def test_toxic_grammar():
    g = toxicity.Grammar({"grumpf": 3.0})
    plain, negated, reported, aimed, threat = (g.features(t) for t in ("a grumpf here", "he is not a grumpf", "she said he is a grumpf", "you grumpf", "i will kill you"))
    assert plain[0] > 0 and negated[0] == 0 and negated[3] > 0 and reported[0] == 0 and reported[4] > 0
    assert aimed[2] > plain[2] == 0 and threat[5] > g.features("to kill time")[5] > 0
    assert g.features("agrumpf is no start of a word") is None


@pytest.mark.parametrize(
    ("text", "where"),
    [
        ("you are an idiot", {"plain", "aimed"}), ("Idiot, that is what you are", {"plain", "aimed"}), ("5\" idiot", {"plain"}), ("idiotically small", set()), ("two idiots. You are here", {"plain"}),
        ('he said: "you are an idiot"', {"reported"}), ('"You are an idiot," he said.', {"reported"}), ('"We won. You are an idiot!" she replied', {"reported"}), ("« Vous êtes un connard » dit-il", {"reported"}),
        ('she said "no." You are an idiot', {"plain", "aimed"}), ('"You are an idiot." We left. She said no', {"plain", "aimed"}),
        ("no one is an idiot", {"negated"}), ("not at all in my view an idiot", {"negated"}), ("I don’t think that you are an idiot", {"negated"}), ("sie ist kein Arschloch", {"negated"}),
        ("not mad but an idiot", {"plain"}), ("no, you idiot", {"plain", "aimed"}), ("not now, you idiot", {"plain", "aimed"}), ("I will not kill you", set()), ("I'll kill you", {"threat"}), ("stabbed and strangled", {"threat"}),
    ],
)
def test_toxic_clauses(text, where):
    found = toxicity.Grammar({}).features(text)
    assert {f for f, x in zip(toxicity.FEATURES, found if found is not None else ()) if x and f != "plain_most"} == where


def test_composed_arcs_are_the_components_one_by_one():
    rng = random.Random(13)
    for components in (toxicity.BACKWARD, toxicity.FORWARD):
        joint = toxicity.Composed(components)
        for _ in range(300):
            symbols = [rng.randrange(toxicity.OTHER + 1) for _ in range(rng.randint(0, 40))]
            want, weights = list(symbols), [1.0] * len(symbols)
            for component in components:
                s = 0
                for i, symbol in enumerate(want):
                    s, want[i], w = component(s, symbol)
                    weights[i] *= w
            state, got = joint.start, []
            for symbol in symbols:
                state, *made = joint.step(state, symbol)
                got.append(tuple(made))
            assert got == list(zip(want, weights))
        assert len(joint.arcs) < 20_000


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_personal(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15 or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((*m.span(), kind))
    return sorted(out)


def test_plain_personal_data():
    rng = random.Random(7)
    for _ in range(20000):
        text = "".join(rng.choice("a1.@+- (25") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.plain(text)) == brute_personal(text)


@pytest.mark.parametrize(
    ("text", "span", "kind"),
    [
        ("mail john.doe at mail dot example dot com now", "john.doe at mail dot example dot com", "email"), ("to jane[at]corp[dot]org please", "jane[at]corp[dot]org", "email"),
        ("call plus four nine one seven one two three four five six seven", "plus four nine one seven one two three four five six seven", "phone"), ("аlice@exаmple.com", "аlice@exаmple.com", "email"),
        ("４１１１ 1111 1111 1111", "４１１１ 1111 1111 1111", "card"), ("ip one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one", "ip"),
    ],
)
def test_disguised_personal_data(text, span, kind):
    found = pii.spans(text)
    assert [(text[a:b], k, added) for a, b, k, added in found if added] == [(span, kind, True)]
    assert span not in pii.masked(text, found)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("alice@example dot com", "email"), ("alice @ example.com", "email"), ("alice@ example.com", "email"), ("alice @example.com", "email"), ("alice AT example DOT com", "email"),
        ("192 dot 168 dot 0 dot 1", "ip"), ("eight dot eight dot eight dot eight", "ip"), ("8 Dot 8 Dot 8 Dot 8", "ip"), ("plus 49 171 2345678", "phone"), ("alice at\nexample dot com", "email"),
    ],
)
def test_each_disguise_alone(text, kind):
    assert pii.spans(text) == [(0, len(text), kind, True)]
    assert pii.masked(f"see {text}, now", pii.spans(f"see {text}, now")) == f"see <{kind.upper()}>, now"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("192[.]168[.]0[.]1", "ip"), ("192 (dot) 168 (dot) 0 (dot) 1", "ip"), ("192 {dot} one six eight [.] 0 . 1".replace(" . ", "."), "ip"), ("4OO1 1111 1111 1114", "card"), ("41ll 1111 1111 1111", "card"),
        ("4lll llll llll 1111", "card"), ("4111 1111 1111 11ll", "card"), ("O123 4567 8901 28", "card"), ("alice at corp dot example", "email"), ("alice at corp dot xyz", "email"), ("alice arroba corp punto barcelona", "email"),
    ],
)
def test_more_disguises_of_digits_and_endings(text, kind):
    assert [s for s in pii.spans(text) if s[2] == kind] == [(0, len(text), kind, True)]


def test_disguises_beside_others():
    text = "in 8 192 dot 168 dot 0 dot 1"
    assert pii.spans(text) == [(5, len(text), "ip", True)]
    for text in ("| 4111 1111 1111 1112 |", "4 Illinois 10l of oil", "at this point we", "he was at a dot near", "open at 10 dot 5"):
        assert pii.spans(text) == []
    assert [s[:3] for s in pii.spans("|4111 1111 1111 1111| I paid")] == [(1, 20, "card")]


def test_spaced_at_of_no_address():
    for text in ("photo by @jane.doe today", "2 kg @ 4.50 each", "we met @ noon. Then"):
        assert pii.spans(text) == []


def test_clean_text_has_no_personal_data(spark):
    for text in ("look at example.com today", "he was at the dot and of. But", "one two three", "in 1999 and 2004", "un deux trois", "a.b.c.d"):
        assert pii.spans(text) == []
    out = pii.personal_data(table(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(not r.spans for r in out)
    docs = base.documents(spark, SF)
    got = {r.doc_id: r.base_sha256 for r in catalog.op7_pii(spark, SF).collect()}
    for r in docs.collect():
        spans = sorted(brute_personal(r.text), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def test_hamming_odd(spark):
    rows = [(i, 0 if i < 50 else i * 0x9E3779B97F4A7C15 % (1 << 62)) for i in range(200)] + [(None, 1), (7, 0), (300, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = sorted(map(tuple, hamming.top_k(df, df.where("id % 20 = 0"), "id", "code", 5).collect()))
    own = {(i, c) for i, c in rows if i is not None and c is not None}
    want = []
    for q, c in own:
        if q % 20 == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in own if i != q)[:5]
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert hamming.top_k(df.limit(0), df, "id", "code").count() == 0


def test_signs(spark):
    rows = [([1.0, -1.0] * 32,), ([0.5],), (None,), ([None, float("nan"), 2.0],), ([],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in df.select(hamming.signs("v")).collect()] == [0x5555555555555555, 1, None, 4, 0]
    with pytest.raises(Exception, match="65 components"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming.signs("v")).collect()


def test_quality(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 40) if i % 3 else words(rng, 40, ["###", "$$$", "%%%"])) for i in range(300)]
    docs = table(spark, rows)
    out = quality.resampled(docs, docs.where("doc_id % 3 <> 0 AND doc_id < 100"), share=0.6).collect()
    assert sum(r.selected for r in out) == 180 and not any(r.selected for r in out if r.doc_id % 3 == 0)
    keys = spark.createDataFrame([(i * i * (-1) ** i,) for i in range(100)], "rank_key long")
    order = sorted((i * i * (-1) ** i for i in range(100)), reverse=True)
    assert [quality.threshold(keys, k) for k in (1, 50, 100)] == [order[0], order[49], order[99]]
    assert len(quality.resampled(table(spark, ODD), docs.limit(0)).collect()) == len(ODD)
    assert quality.resampled(docs.limit(0), docs).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = base.documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = base.written(stage(spark, docs, SF), name)
        assert sorted(out.columns) == sorted(docs.columns)
        before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
        assert after.keys() <= before.keys() and all(r.n_chars == len(r.text) for r in after.values())
        if name == "language":
            model = langid.trained(docs.where(~catalog.held_out()))
            want = {i for i, r in before.items() if langid.LETTER.search(r.text or "") and brute_language(model, r.text)[1] / len(r.text.lower().encode()) >= langid.NARROW}
            assert after.keys() == want and all(r.text == before[i].text for i, r in after.items())
        if name == "near_dedup":
            assert after.keys() == {i for i, (_, c) in brute_components([(i, r.text) for i, r in before.items()]).items() if i == c}
        if name == "suffix_dedup":
            want = brute_repeats([before[i].text.encode() for i in sorted(before)], 200)
            assert all(abs(len(after[i].text.encode()) - len(kept)) <= 4 * n for i, (kept, n) in zip(sorted(before), want))
        if name == "pii":
            assert all(r.text == pii.masked(before[i].text, pii.spans(before[i].text)) for i, r in after.items())
        docs = out
        sizes.append(len(after))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_pipeline_keeps_the_text_of_repeated_rows(spark):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    a, b, c, d, e, f = (words(rng, 90, vocabulary) for _ in range(6))
    rows = [(1, a), (1, a), (2, b), (3, a), (4, None), (4, c), (4, c[:100]), (None, d), (None, d), (5, None), (5, ""), (6, f), (6, e), (6, f), (6, e + " w1")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        docs = base.written(stage(spark, docs, SF), "stage")
        got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
        assert got == sorted([(0, d), (0, d), (1, a), (2, b), (4, c[:100]), (4, c), (5, ""), (6, e + " w1"), (6, f)])


def test_held_out_is_crc32(spark):
    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", catalog.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    assert oracles.NEAR_DEDUP and oracles.HAMMING


def test_repeats_of_clashing_ids(spark):
    rng = random.Random(8)
    shared, a, b, c = ("".join(rng.choice("abcdef") for _ in range(n)) for n in (60, 80, 90, 70))
    rows = [(1, a + shared), (1, b), (2, c + shared), (3, None)]
    out = suffix_dedup.without_repeats(table(spark, rows), length=20, gram=6).collect()
    assert sorted(bytes(r.kept).decode() for r in out) == sorted([a, b, c, ""])


@pytest.mark.parametrize("hot", [5000, 2])
def test_groups_are_complete_over_tasks(spark, hot):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdefgh") for _ in range(50)) for _ in range(4)]
    texts = ["".join(rng.choice(passages)[rng.randint(0, 9) :] + "".join(rng.choice("uvwxyz") for _ in range(30)) for _ in range(3)) for _ in range(40)]
    texts += texts[:3]
    docs = table(spark, list(enumerate(texts)), False).repartition(5)
    groups = collections.defaultdict(set)
    for r in suffix_dedup.repeated(docs, length=20, gram=6, hot=hot).collect():
        groups[r.repeat].add((r.doc_id, r.start, r.size))
    assert groups
    for group in groups.values():
        (string,) = {texts[i][a : a + n] for i, a, n in group}
        assert {(i, a) for i, a, _ in group} == {(i, a) for i, t in enumerate(texts) for a in range(len(t)) if t.startswith(string, a)}


def test_quality_is_a_plain_loop_s(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(0, 30)) for _ in range(60)] + [None]
    docs, good = table(spark, list(enumerate(texts))), set(range(0, 60, 4))
    got = {r.doc_id: r for r in quality.resampled(docs, docs.where("doc_id % 4 = 0 AND doc_id < 60"), share=0.5).collect()}
    own = [collections.Counter(quality.buckets_of([t])[0].tolist()) for t in texts]
    totals = [collections.Counter(), collections.Counter()]
    for i, c in enumerate(own):
        totals[1].update(c)
        totals[0].update(c if i in good else {})
    share = lambda t, b: (t[b] + quality.SMOOTHING) / (sum(t.values()) + quality.SMOOTHING * quality.BUCKETS)
    want = [sum(n * np.log(share(totals[0], b) / share(totals[1], b)) for b, n in c.items()) for c in own]
    assert all(abs(got[i].log_weight - w) < 1e-9 for i, w in enumerate(want))
    noise = [got[i].key - got[i].log_weight for i in range(len(texts))]
    assert len(set(noise)) == len(noise) and -1 < np.mean(noise) < 2
    best = sorted(range(len(texts)), key=lambda i: -got[i].key)[:31]
    assert {i for i, r in got.items() if r.selected} == set(best)


def test_quality_ties_go_to_smaller_ids(spark):
    docs = table(spark, [(i, None) for i in range(5)] + [(7, "x"), (7, "x")])
    keys = quality.resampled(docs, docs.limit(0), share=0.4).collect()
    assert sum(r.selected for r in keys) >= 3


def test_langid_with_other_columns_and_ties(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "x", 5, "q"), (2, "aaa bbb", "y", 6, "q"), (3, "aaa bbb", "x", 7, "q")], "doc_id long, text string, lang string, n long, h string")
    model = langid.trained(docs)
    assert {lang for lang, _, _ in model} == {"x", "y"}
    (r,) = langid.identified(docs.where("doc_id = 2"), model).collect()
    assert r.lang_pred == "x" and r.rejected and r.margin == 0  # equal sizes: the language with more rows
    assert langid.identified(docs.limit(0), model).count() == 0


def test_addresses_of_any_number_of_labels():
    for n in (1, 7, 40):
        text = "mail " + " dot ".join(f"ab{i}" for i in range(n)) + " at " + " dot ".join(f"cd{i}" for i in range(n)) + " dot example dot com now"
        assert [(text[a:b].split()[0], text[a:b].split()[-1]) for a, b, kind, *_ in pii.spans(text) if kind == "email"] == [("ab0", "com")]
    assert not [s for s in pii.spans("he is at work dot com") if s[2] == "email"]
    chain = " dot ".join(["word"] * 20_000)
    import time

    began = time.time()
    assert pii.spans("x at y.z " + chain) is not None and time.time() - began < 20


def test_training_rows_are_bounded(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CAST(id % 2 AS INT) AS toxic")
    few = toxicity.least(df.unionByName(df), F.xxhash64("doc_id"), 20)
    assert few.count() == 20 and few.select("doc_id").distinct().count() == 20
    assert toxicity.sampled(df.unionByName(df), 25).count() == 50 and toxicity.sampled(df.limit(0)).count() == 0
    assert toxicity.trained(df, rows=0)[0] == {} and toxicity.trained(df, size=0)[0] == {}
