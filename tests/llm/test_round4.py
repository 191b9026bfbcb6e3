"""Token blocks and files that only large inputs have."""

import shutil

import numpy as np
import public_tokenizers

from tracelens.llm import idcodec
from tracelens.llm import token_output as O

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_long_sure_guess_leaves_the_other_one_a_width():
    """After some 200 hits of order 2 its part of the range is full; then comes what order 1 guesses."""
    a = np.array([5, 6, 5, 7] * 400 + [5, 6, 5, 6] + [9] * 50, np.uint16)
    assert (idcodec.decode_blocks(idcodec.encode_blocks(a), len(a)).ravel() == a).all()
    (docs, blocks), = O.parse(b"".join(r + b"\n" for r in O.group_records([(1, len(a))], a)))
    assert (O.ids_of(blocks) == a).all()


def test_files_are_ordered_by_their_count_whatever_the_jobs_id(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (k + 1)) for k in range(4)], "doc_id LONG, text STRING")
    for k in range(4):
        O.write_tokens(docs.where(f"doc_id = {k}"), str(tmp_path / f"one{k}"), PATH)
        file, = (f for f in (tmp_path / f"one{k}").glob("part-*") if f.stat().st_size)
        (tmp_path / "part-7").mkdir(exist_ok=True)
        shutil.copy(file, tmp_path / "part-7" / f"part-0000{k // 2}-3f2a9d10-c{9 - k}1b-4e5f-8a6b-c{9 - k}3344556677-c00{k % 2}.txt")
    found = O.read_tokens(spark, str(tmp_path / "part-7")).orderBy("doc_id").collect()
    sizes = [r.n_tokens for r in found]
    assert [r.start for r in found] == [sum(sizes[:k]) for k in range(4)] and [r.doc_id for r in found] == [0, 1, 2, 3]
