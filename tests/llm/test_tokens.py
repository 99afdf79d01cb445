import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from saldora.llm import id_files, langid, nbest, token_counts
from saldora.llm.queries import tokenizer

ODD = ["ΣΑΣ Σ İı ﬁ é é ² ½ x² 1234 it's IT'S we'll'", "   \n\n  a\t\tb  c d  ", "\x1c\x1d a\x1cb", "🙂🙂👨‍👩‍👧 ok", "ⅷ٣ 三", "a\x85b", "aaaaaaaaaaa aaaa", "<|endoftext|>x<|startoftext|> y", "𝒳𝒴 𝟙𝟚"]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_token_counts_equal_the_library(docs, rows, spark, libraries, empty):
    lib, path = libraries["word_bpe_49k.json"], tokenizer("word_bpe_49k.json")
    odd = spark.createDataFrame([(900 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    got = token_counts.token_counts(docs.select("doc_id", "text").union(odd), path, limit=100).collect()
    want = [(len(t.encode()), n, n > 100) for t in [r[1] or "" for r in rows] + ODD for n in [len(lib.encode(t, add_special_tokens=False).ids)]]
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_small_cache_gives_the_same(libraries):
    tool = token_counts.TokenCounter(tokenizer("word_bpe_49k.json"), cache=5)
    texts = [f"{w} lorem{k} ipsum" for k, w in enumerate(ODD)]
    assert [tool.count([t])[0] for t in texts] == [len(libraries["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (id_files.from_planes(id_files.to_planes(ids, kind), n, kind) == ids).all()


def test_id_files_round_trip(docs, rows, spark, libraries, empty, tmp_path):
    lib, path = libraries["byte_bpe_50k.json"], tokenizer("byte_bpe_50k.json")
    odd = spark.createDataFrame([(900 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    got = id_files.id_files(docs.select("doc_id", "text").union(odd), path, kind="bit", folder=f"file://{tmp_path}/ids").collect()
    everything = sorted([(r[0], r[1]) for r in rows] + [(900 + k, t) for k, t in enumerate(ODD)], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for doc, text in everything:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert id_files.id_files(empty, path).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_chunks_and_documents_of_one_file(tmp_path, kind):
    rng, lens = np.random.default_rng(3), [0, 5, 1, 40, 0, 7, 300, 2]
    ids = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in lens]
    with pa.OSFile(str(tmp_path / "a.ids"), "wb") as out:
        writer = id_files.FileWriter(out, kind, chunk=16)
        for k, x in enumerate(ids):
            writer.add([k], [len(x)], x)
        assert writer.close() == sum(lens)
    with pa.OSFile(str(tmp_path / "a.ids")) as file:
        reader, flat = id_files.FileReader(file), np.concatenate(ids)
        assert (reader.read(9) == flat[144:160]).all() and (reader.read(2) == flat[32:48]).all()
        assert all((reader.document(k) == x).all() for k, x in enumerate(ids))
        assert [(d, at, x.tolist()) for d, at, x in reader.documents()] == [(k, sum(lens[:k]), x.tolist()) for k, x in enumerate(ids)]


def segmentations(word, pieces):
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in pieces or len(p) == 1 for p in parts):
            yield parts


def test_forward_sums_all_segmentations():
    v = langid.Vocabulary(tokenizer("piece_bpe_32k.model"))
    ids, rng = {n: k for k, n in enumerate(v.names)}, np.random.default_rng(0)
    probs = rng.random((v.size, 3))
    probs /= probs.sum(0)
    words = ["the", "hello", "übertrag", "a", "漢字x", "ǿᚠb"]
    want = [np.log(sum(np.prod([probs[ids.get(p, v.unknown)] for p in s], axis=0) for s in segmentations("▁" + w, ids))) for w in words]
    got = langid.word_scores(v, words, langid.scaled(v, probs))
    assert np.abs(got - np.array(want)).max() < 1e-9
    long = "abcdefghij" * 5
    assert np.abs(langid.long_word(v, long, langid.scaled(v, probs)) - np.log(langid.Lattices(v, [long]).forward(langid.scaled(v, probs))[0, len(long) + 1]) + (len(long) + 1) * np.log(langid.SCALE)).max() < 1e-9


def test_language_of_held_out_documents(spark, sf_dir, docs, rows, empty):
    path = tokenizer("piece_bpe_32k.model")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(table, path).where("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    odd = langid.identify(docs, path).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    und = {r.doc_id for r in odd if r.lang_pred == "und"}
    assert und >= {r[0] for r in rows if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    assert langid.identify(empty, path).count() == 0 and langid.known_language(docs, path).columns == docs.columns


TEXTS = ["the cat sat", "a b", "über\nx y", "▁x", "漢 z", "hello, w", "aaaa", "x  y", "12ab!!", "ǿᚠ"]


def test_nbest_by_brute_force():
    e = nbest.Encoder(tokenizer("piece_bpe_32k.model"), n=4)
    score = {t: s for t, (s, _) in e.tool.piece.items()}
    assert abs(sum(np.exp(s) for s in score.values()) - 1) < 1e-9
    cost = lambda ids: sum(e.tool.score.get(k, 0.0) for k in ids)
    lens, flat, scores, edits = e.encode(TEXTS)
    ends = np.cumsum(lens)
    ok = e.decoded_ok(TEXTS, lens, flat)
    for k, text in enumerate(TEXTS):
        marked = "▁" + text.replace(" ", "▁")
        all_ = sorted((sum(score.get(p, e.tool.unknown) for p in s) for s in segmentations(marked, score)), reverse=True)[:4]
        assert np.allclose(scores[k], all_) and ok[k] == ("▁" not in text)
        best = flat[ends[k] - lens[k] : ends[k]].tolist()
        lists = [best, *(nbest.apply_edits(best, d) for d in edits[k])]
        assert len(lists) == len(scores[k]) == len({tuple(x) for x in lists})
        for ids, s in zip(lists, scores[k]):
            assert e.tool.decode(ids) == text.replace("▁", " ")
            if all(c in score for c in marked):
                assert abs(cost(ids) - s) < 1e-9


def test_nbest_equals_the_library_with_these_scores(spark, sf_dir, tmp_path):
    """The same pieces and scores as a unigram model of the library: its best segmentation and its n best."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = tokenizer("piece_bpe_32k.model")
    e, model = nbest.Encoder(path), proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for k, s in e.tool.score.items():
        model.pieces[k].score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["the cat sat", "Enözuver die enie", "thinges 12ab!!", "x  y"]:
        lens, flat, _, edits = e.encode([text])
        assert [flat.tolist(), *(nbest.apply_edits(flat.tolist(), d) for d in edits[0])] == library.nbest_encode_as_ids(text, 3)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    cost, same = lambda ids: sum(e.tool.score.get(k, e.tool.unknown) for k in ids), 0
    lens, flat, _, _ = e.encode(texts)
    for text, n, end in zip(texts, lens.tolist(), np.cumsum(lens).tolist()):
        mine, theirs = flat[end - n : end].tolist(), library.encode(text)
        same += mine == theirs
        assert mine == theirs or cost(mine) >= cost(theirs) - 1e-2  # the library adds in single precision
    assert same >= 0.9 * len(texts)
    with open(tmp_path / "unigram.model", "wb") as f:
        f.write(model.SerializeToString())
    own = nbest.NBest(str(tmp_path / "unigram.model"))  # a unigram model's scores are taken as they are
    assert all(abs(own.score[k] - s) < 1e-4 for k, s in e.tool.score.items())


def test_segmented_expanded_decoded(docs, rows, empty):
    path = tokenizer("piece_bpe_32k.model")
    found = nbest.segmented(docs, path).cache()
    got = found.collect()
    assert len(got) == len(rows) and all(r.decoded_ok and r.scores == sorted(r.scores, reverse=True) and len(r.others) == len(r.scores) - 1 for r in got)
    assert all(r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    each = nbest.expanded(found).collect()
    assert sorted((r.doc_id or -1, r.rank, round(r.score, 6)) for r in each) == sorted((r.doc_id or -1, k, round(s, 6)) for r in got for k, s in enumerate(r.scores, 1))
    texts = sorted((r[0] or -1, r[1] or "") for r in rows)
    assert sorted((r.doc_id or -1, r.text) for r in nbest.decoded(found, path).collect()) == texts
    again = nbest.decoded(nbest.expanded(found).where("rank = 2"), path).collect()
    assert {(r.doc_id or -1, r.text) for r in again} <= set(texts) and again
    assert nbest.segmented(empty, path).count() == 0 and nbest.expanded(nbest.segmented(empty, path)).count() == 0


def test_small_cache_gives_the_same_pieces():
    path = tokenizer("piece_bpe_32k.model")
    small, large = nbest.Encoder(path, cache=6), nbest.Encoder(path)
    for k in range(30):
        text = [f"the cat {'abcdefgh'[k % 8]} sat {'xyz' * (k % 5)} on word{k}"]
        for a, b in zip(small.encode(text), large.encode(text)):
            assert np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b


def test_very_long_texts_and_words():
    e = nbest.Encoder(tokenizer("piece_bpe_32k.model"))
    texts = ["x" * 200_000, "lorem ipsum dolor " * 60_000]
    lens, flat, scores, _ = e.encode(texts)
    assert e.decoded_ok(texts, lens, flat).all() and all(len(s) == 3 for s in scores)
