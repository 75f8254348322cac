"""Token files, packing and merge-dropout against the tokenizer libraries."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from modlens.llm import packing, pieces, token_files
from modlens.llm.registry import QUERIES
from modlens.llm.tokens import WordIds
from modlens.session import run_dir
from cases import crc, empty, frame, odd, odd_rows, prose, texts  # noqa: F401

BYTE, WORD = token_files.vocabulary("byte_bpe_50k.json"), token_files.vocabulary("word_bpe_49k.json")
ODD = [
    "", "  a b", "a  b", "a \n b", "x\ty", "\n", "a ", "<|endoftext|> hi", "<|ENDOFTEXT|>.", "Don't it's 's",
    "a b\x1cc", "é.é, ½. x½.", "\0 \0a b\0", "foo.,bar. ...", '"q." Σας ΣΑΣ.', "a  b\r\nc d\x0b", "word\u00a0word",
]


SCRAPS = [
    "a", "Hello", "WORLD", "don't", "I'LL", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<", "\0",
    " ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000", "\ufeff",
    "e\u0301", "\u0301", "\u00c9", "\u00bd", "\u03a3", "\u0130", "\u65e5\u672c", "\U0001f600", "7", "2024", ".", ",", "...", "_", "-", "'s", '"', "(", ")",
]


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(SCRAPS, rng.integers(0, 14)).tolist()) for _ in range(n)]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_random_texts_get_the_ids_of_the_library(path, spaced):
    store = WordIds(path, spaced)
    assert store.by_words
    group = random_texts(6000, 11) + [f"{a} {b}" for a in SCRAPS for b in SCRAPS]
    group += ["if (A <|> B) Then Print", "Hello World, this is Plain prose <| Foo Bar", "HELLO <|endoftext|> The End", "abc \0 def"]
    for at in range(0, len(group), 500):
        part = group[at : at + 500]
        ids, ends = store.encode(part)
        for text, own, plain in zip(part, np.split(ids, ends[:-1]), store.whole(part)):
            assert own.tolist() == plain, repr(text)


def test_other_tokenizers_see_whole_texts(tmp_path):
    import json

    # The same model, but its texts lose their capitals.
    spec = json.loads(open(BYTE).read())
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    store = WordIds(str(tmp_path / "t.json"), True)
    assert not store.by_words
    group = random_texts(200, 3) + [""]
    ids, ends = store.encode(group)
    assert [o.tolist() for o in np.split(ids, ends[:-1])] == store.whole(group)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORD, False)])
def test_known_words_change_nothing(texts, path, spaced):
    store = WordIds(path, spaced, most=300)
    for group in [[t for _, t in texts[:60]], ODD, *[[t] for t in ODD], [t for _, t in texts[:60]]]:
        ids, ends = store.encode(group)
        last = 0
        for text, end, plain in zip(group, ends, store.whole(group)):
            assert ids[last:end].tolist() == plain, text[:60]
            last = end


def test_token_files_on_the_table(spark, folder, texts):
    plain, start = [], 0
    for key, text in texts:
        ids = ids_of(BYTE, text) + [2]
        plain.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_token_files"].run(spark, folder).collect())) == plain


@pytest.mark.parametrize("width", [2, 4])
def test_token_files_on_odd_rows(spark, odd, width):
    path = run_dir(spark, "tokens")
    token_files.write_token_files(odd, path, BYTE, True, 50256, width=width)
    got = sorted(map(tuple, token_files.read_token_files(spark, path, width).collect()), key=lambda r: r[1])
    want = sorted(((k, len(i), crc(i)) for k, i in ((k, ids_of(BYTE, t) + [50256]) for k, t, _, _ in odd_rows())), key=str)
    assert sorted(((k, n, c) for k, _, n, c in got), key=str) == want
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()


def test_token_files_map_into_memory(spark, texts, folder):
    path = run_dir(spark, "tokens")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    token_files.write_token_files(docs.coalesce(1).limit(1), path, BYTE, True, 2)
    import glob

    (name,) = [p for p in glob.glob(path.removeprefix("file:") + "/part-*") if np.memmap(p, "u1").size]
    one = docs.coalesce(1).limit(1).first()
    want = ids_of(BYTE, one["text"]) + [2]
    ids, keys, offsets = token_files.mapped(name)
    assert isinstance(ids, np.memmap) and ids.tolist() == want
    assert keys.tolist() == [one["doc_id"]] and offsets.tolist() == [0]


def test_ids_beyond_the_width_stop_the_job(spark, odd, tmp_path):
    with pytest.raises(ValueError, match="does not fit"):
        token_files.write_token_files(odd, str(tmp_path / "a"), BYTE, True, 1 << 16)
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(odd, str(tmp_path / "b"), BYTE, True, 2, width=1)


def test_token_files_of_nothing(spark, empty):
    path = run_dir(spark, "tokens")
    token_files.write_token_files(empty, path, BYTE, True, 2)
    assert token_files.read_token_files(spark, path).count() == 0


def check_packing(rows, want, size):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r.length for r in rows) // size)


def pieces_of(rows, size=4096):
    out = []
    for key, text in rows:
        ids = ids_of(WORD, text) + [1]
        out += [(key, n, at, len(ids[at : at + size]), crc(ids[at : at + size])) for n, at in enumerate(range(0, len(ids), size))]
    return out


def test_packing_on_the_table(spark, folder, texts):
    rows = QUERIES["op3_packing"].run(spark, folder).collect()
    used, least = check_packing(rows, pieces_of(texts), 4096)
    assert used <= least * 1.02 + 1


def test_packing_on_odd_rows_and_many_shards(spark, odd):
    s = packing.PackSettings(size=64, shard=40, pool=3, islands=3, epochs=2)
    rows = packing.pack(packing.pieces(odd, WORD, 1, 64), s).collect()
    used, least = check_packing(rows, pieces_of([(k, t) for k, t, _, _ in odd_rows()], 64), 64)
    assert used <= least * 1.1 + 2


def test_packing_of_nothing(empty):
    assert packing.pack(packing.pieces(empty, WORD, 1, 4096)).count() == 0


def pieces_frame(spark, lengths):
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, packing.PIECE)


@pytest.mark.parametrize("lengths", [[1300] * 1300 + [2500] * 650, [40] * 3000, [1] * 2000])
def test_packing_keeps_shards_bounded_where_sequences_stay_open(spark, monkeypatch, lengths):
    s, sizes, plain = packing.PackSettings(shard=100), [], packing.pack_shards
    if lengths[0] == 1:
        s = packing.PackSettings(size=100, shard=100)

    def watched(items, settings):
        sizes.append(max(r["count"] for r in items.groupBy("shard").count().collect()))
        return plain(items, settings)

    monkeypatch.setattr(packing, "pack_shards", watched)
    fill = {}
    rows = packing.pack(pieces_frame(spark, lengths), s).collect()
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths))) and max(fill.values()) <= s.size
    assert max(sizes) < 1.7 * s.shard
    whole = packing.Packing(np.array(lengths), s.size)
    whole.best_fit(packing.falling(whole.lengths, 0.0, np.random.default_rng(1)))
    assert len(fill) <= 1.05 * len(whole.bins) + 1


def test_sequences_of_two_shards_never_share_a_number(spark, monkeypatch):
    def two_shards(items, s):
        return spark.createDataFrame(
            [(r["item"], n, r["length"], (1 - n) << 20) for n, r in enumerate(items.collect())],
            "item long, shard long, length long, bin long",
        )

    monkeypatch.setattr(packing, "pack_shards", two_shards)
    rows = packing.pack(pieces_frame(spark, [4096, 4096]), packing.PackSettings(shard=1)).collect()
    assert len({r["sequence_id"] for r in rows}) == 2 and {r["offset"] for r in rows} == {0}


def test_children_are_packings():
    rng = np.random.default_rng(0)
    s = packing.PackSettings(size=100, children=6)
    lengths = rng.integers(20, 70, 200)
    found = packing.evolve(lengths, [], s, 3)
    fills = np.bincount(found, lengths)
    assert fills.max() <= 100 and len(found) == 200
    plain = packing.Packing(lengths, 100)
    plain.best_fit(packing.falling(lengths, 0.0, rng))
    assert len(fills) <= len(plain.bins)
    assert (packing.evolve(lengths, [found], s, 3) >= 0).all()


def test_merge_dropout_of_rate_zero_is_the_plain_model(texts):
    import sentencepiece

    path = token_files.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = pieces.Encoder(path, pieces.DropoutSettings(rate=0.0))
    for group in ([t for _, t in texts[:50]], [t for t in ODD if "\0" not in t], [prose(1, 5) + "z" * 200]):
        ids, ends = enc.encode(range(len(group)), group)
        last = 0
        for text, end in zip(group, ends):
            assert ids[last:end].tolist() == model.encode(text), text[:60]
            assert enc.p.decode(ids[last:end]) == text
            last = end


def test_merge_dropout_agenda_and_arrays_agree():
    enc = pieces.Encoder(token_files.vocabulary("piece_bpe_32k.model"), pieces.DropoutSettings(rate=0.3))
    units = [u for t in ODD + [prose(2, 80)] for u in enc.units(t)]
    keys = pieces.mixed(np.arange(len(units), dtype=np.uint64))
    flat, sizes = enc.p.symbols(units)
    got, counts = enc.segmenter.segment(units, keys)
    rows = np.split(flat, np.cumsum(sizes)[:-1])
    alone = [enc.segmenter.alone(r, int(k)) for r, k in zip(rows, keys)]
    assert [g.tolist() for g in np.split(got, np.cumsum(counts)[:-1])] == alone


def by_agenda(enc, key, text):
    """Pieces of a text, one unit at a time by the agenda."""
    units = enc.units(text)
    keys = enc.keys(np.array([enc.variant(key)], np.uint64), np.array([len(units)]))
    return [i for u, k in zip(units, keys) for i in enc.segmenter.alone(enc.p.symbols([u])[0], int(k))]


@pytest.mark.parametrize("rate", [0.02, 0.1, 0.5, 1.0])
def test_merge_dropout_of_kept_units_is_that_of_the_agenda(rate):
    # A store of few units starts anew several times.
    enc = pieces.Encoder(token_files.vocabulary("piece_bpe_32k.model"), pieces.DropoutSettings(rate=rate), known=60)
    group = [*ODD, prose(3, 200), "word " * 50 + "x" * 300, "\U0001f600" * 20, "moderation " * 40, prose(4, 60), *random_texts(60, 3)]
    for at in range(0, len(group), 7):
        part = group[at : at + 7]
        ids, ends = enc.encode(range(at, at + len(part)), part)
        for n, (text, own) in enumerate(zip(part, np.split(ids, ends[:-1]))):
            assert own.tolist() == by_agenda(enc, at + n, text), repr(text)


def test_merge_dropout_draws_for_every_place_of_a_word():
    enc = pieces.Encoder(token_files.vocabulary("piece_bpe_32k.model"), pieces.DropoutSettings())
    ids, ends = enc.encode([7], ["moderation " * 500])
    units, at = [], 0
    for unit in enc.units("moderation " * 500)[:500]:
        size, spelled = 0, b""
        while len(spelled) < len(unit):
            spelled += enc.p.decode_bytes(ids[at + size : at + size + 1]).tobytes()
            size += 1
        units.append(tuple(ids[at : at + size].tolist()))
        at += size
    assert len(set(units)) > 20


def test_merge_dropout_on_the_table(spark, folder, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op4_merge_dropout"].run(spark, folder).collect()}
    assert sorted(rows) == [k for k, _ in texts] and all(r["lossless"] for r in rows.values())
    enc = pieces.Encoder(token_files.vocabulary("piece_bpe_32k.model"), pieces.DropoutSettings())
    for key, text in texts[:40]:
        ids = by_agenda(enc, key, text)
        assert (rows[key]["n_tokens"], rows[key]["ids_crc32"]) == (len(ids), crc(ids))


def test_merge_dropout_draws_for_every_document():
    enc = pieces.Encoder(token_files.vocabulary("piece_bpe_32k.model"), pieces.DropoutSettings())
    ids, ends = enc.encode(range(300), [prose(5, 60)] * 300)
    drawn = {tuple(own.tolist()) for own in np.split(ids, ends[:-1])}
    assert len(drawn) > 290 and {enc.p.decode(own) for own in drawn} == {prose(5, 60)}
    words, ends = enc.encode(range(2000), ["moderation"] * 2000)
    assert len({tuple(own.tolist()) for own in np.split(words, ends[:-1])}) > 4


def test_merge_dropout_on_odd_rows(odd, empty):
    path = token_files.vocabulary("piece_bpe_32k.model")
    rows = pieces.encode(odd, path, pieces.DropoutSettings(rate=0.5)).collect()
    spell = pieces.Pieces(path).decode
    want = [(k, t or "") for k, t, _, _ in odd_rows()]
    assert sorted([(r["doc_id"], spell(r["ids"])) for r in rows], key=str) == sorted(want, key=str)
    assert pieces.encode(empty, path, pieces.DropoutSettings()).count() == 0
    seeds = [pieces.encode(odd, path, pieces.DropoutSettings(seed=s)).agg({"ids_crc32": "sum"}).first()[0] for s in (1, 1, 2)]
    assert seeds[0] == seeds[1] != seeds[2]
