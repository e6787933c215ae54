import numpy as np

from palimpsest.llm import bpe, token_file


def test_unseen_words_get_the_librarys_ids(monkeypatch):
    spec, words = bpe.read_spec(), ["ÿ", "\n", " é", "\x00a", "日本", "x" * 40]
    monkeypatch.setattr(token_file, "_library", {})
    import tokenizers

    want = [tokenizers.Tokenizer.from_str(spec.decode()).encode(w, add_special_tokens=False).ids for w in words]
    assert token_file.library_encoder(spec).encode_words(words) == want
    assert token_file.library_encoder(spec).encode_words([]) == []


def test_batches_of_token_files_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        token_file.read_file(token_file.write_file(docs, bpe.read_spec())).collect()
        assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.unset(name)


def test_ids_of_all_sizes_come_back():
    ids = np.random.default_rng(3).integers(0, 1 << 16, 3 * token_file.BLOCK_IDS + 5).astype(np.uint32)
    ids[-1] = 0xFFFF
    for n in (1, 2, token_file.BLOCK_IDS, len(ids)):
        assert (token_file.unpack(token_file.pack(ids[-n:])) == ids[-n:]).all()
