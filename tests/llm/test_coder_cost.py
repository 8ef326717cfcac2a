"""Token files: what a block's code costs to read, and that it reads as before."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np

from grainmill.llm import range_coder, token_files
from grainmill.llm.range_coder import decode, encode


def blocks():
    rng = np.random.default_rng(7)
    return [np.minimum(rng.zipf(1.2, n) - 1, 49407) for n in (0, 1, 700, 4096)] + [np.tile([4, 8, 15], 600)]


def test_the_code_is_the_one_of_files_written_before():
    assert zlib.crc32(b"".join(encode(blocks()))) == 775772618


def test_an_id_and_its_interval_are_found_in_one_walk(monkeypatch):
    coded = encode(blocks())

    def again(*_):
        raise AssertionError("the interval of an id that was found is looked up again")

    monkeypatch.setattr(range_coder.Model, "interval", again)
    assert all((a == b).all() for a, b in zip(blocks(), decode(coded), strict=True))


def test_found_intervals_are_those_that_are_coded():
    model, rng = range_coder.Model(50), np.random.default_rng(8)
    for _ in range(40):
        _, share = model.predict(50)
        ids = np.minimum(rng.zipf(1.3, 50) - 1, 49407)
        start, width = model.interval(ids, share)
        for value in (start, start + width - 1):
            got = model.find(value, share)
            assert (got[0] == ids).all() and (got[1] == start).all() and (got[2] == width).all()
        model.update(ids)


def test_checksums_are_joined_by_shifts_made_once(monkeypatch):
    times, calls = token_files._matrix_times, []
    monkeypatch.setattr(token_files, "_matrix_times", lambda *x: calls.append(1) or times(*x))
    first, second = b"abc" * 999, bytes(range(256)) * 321
    assert token_files.joined_crc(zlib.crc32(first), zlib.crc32(second), len(second)) == zlib.crc32(first + second)
    assert len(calls) <= len(second).bit_length()


def test_words_are_encoded_without_threads():
    code = "import os; os.environ.pop('TOKENIZERS_PARALLELISM', None)\nfrom grainmill.llm.tokens import id_bytes, tokenizer_path\nid_bytes(tokenizer_path('word_bpe_49k.json'))('a b')\nprint(os.environ.get('TOKENIZERS_PARALLELISM'))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "false"


def test_ids_are_summed_up_by_the_worker_that_decodes_them(spark, tmp_path):
    docs = spark.createDataFrame([(2, "a b c " * 3000), (1, None), (3, "d e")], "doc_id bigint, text string")
    token_files.write_ids(docs, str(tmp_path / "ids"))
    files = spark.read.parquet(str(tmp_path / "ids"))
    plan = token_files.token_index(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the slices, and the documents of several slices
    index = {r.doc_id: r for r in token_files.token_index(files).collect()}
    ids = {}
    for r in sorted(token_files.read_ids(files).collect(), key=lambda r: (r.part, r.start)):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
    assert {i: (r.n_tokens, r.ids_crc32) for i, r in index.items()} == {i: (len(x) // 4, zlib.crc32(x)) for i, x in ids.items()}
    assert index[2].n_tokens > 2 * range_coder.BLOCK
