"""Word BPE: ids and decoded texts of the tokenizers library, the lookahead by brute force."""

import hashlib
import itertools
import os
import random

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer

from glosswerk.llm import wordbpe
from glosswerk.llm.shared import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(wordbpe.default_path())


@pytest.fixture
def codec():
    return wordbpe.Codec(wordbpe.default_path())


def ids_of(codec, text, **how):
    return np.frombuffer(codec.encode(text, **how), "<u4").tolist()


def test_digests_are_those_of_the_library(spark, docs, rows, empty, library):
    texts = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()] + [(r[0], r[1]) for r in rows]
    r = random.Random(5)
    texts += [(900, "x<|endoftext|>Don't <|startoftext|><|endoftext|> ΣΑΣ İstanbul é 각 \x1c\x85 ١²"), (901, "".join(r.choice("abcdefghijklmnop") for _ in range(100_000))), (902, "漢字 かな, naïve. " * 9000), (903, "!?" * 40_000)]
    want = []
    for k, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = wordbpe.digests(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert wordbpe.digests(empty).count() == 0
    assert len(wordbpe.digests(docs).collect()) == len(rows)
    assert wordbpe.encode(docs, ids="score").columns[-1] == "score"
    assert wordbpe.decode(wordbpe.encode(docs, ids="score"), ids="score", out="key").columns[-1] == "key"


@pytest.mark.parametrize("size", [3, 7, 50])
def test_blocks_and_windows_change_nothing(monkeypatch, codec, library, size):
    r = random.Random(size)
    alphabet = "\x1c\x85aabbe's!'  re<|́̈̈́éΣσ漢字かな가각ㅏᅡᆨİ😀0١²\n\xa0 ཱི"
    parts = ["the", "ing", "un", "zz", "a", "e", "x", "qu", "ation", "1", "é"]
    monkeypatch.setattr(wordbpe.blocks, "__defaults__", (size,))
    for n in range(1500):
        x = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) if n % 4 else "".join(r.choice(parts) for _ in range(r.randrange(1, 300)))
        x += "<|endoftext|>" + x if n % 5 == 0 else ""
        codec.transducer.window = r.choice([32, 64, 256])
        assert ids_of(codec, x) == library.encode(x, add_special_tokens=False).ids, ascii(x)


def test_text_of_megabytes_without_white_space(codec, library):
    r = random.Random(1)
    x = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_500_000))
    assert ids_of(codec, x) == library.encode(x, add_special_tokens=False).ids
    assert len(codec.transducer.held) == 0


def test_what_is_held_is_bounded(codec):
    most = 0
    for _ in range(2000):
        for ids in codec.transducer.push(b"abracadabra" * 9):
            assert ids
        most = max(most, len(codec.transducer.held))
    assert most <= codec.transducer.window + codec.merges.lookahead


def test_lookahead_against_every_continuation():
    """No boundary with ``lookahead`` symbols after it moves, whatever follows."""
    r = random.Random(3)
    for _ in range(150):
        tokens, rules = ["a", "b"], []
        for _ in range(r.randrange(1, 7)):
            x, y = r.choice(tokens), r.choice(tokens)
            if x + y not in tokens and len(x + y) < 6:
                tokens.append(x + y)
                rules.append((x, y, x + y))
        merges = wordbpe.Merges(rules)

        def ends(text, merges=merges):
            return set(itertools.accumulate(map(len, merges.apply([*text]))))

        for k in range(1, 8):
            for head in map("".join, itertools.product("ab", repeat=k)):
                for tail in map("".join, itertools.product("ab", repeat=3)):
                    moved = ends(head) ^ {e for e in ends(head + tail) if e <= k}
                    assert all(k - e < merges.lookahead for e in moved)


def test_a_list_out_of_order_is_refused():
    with pytest.raises(ValueError):
        wordbpe.Merges([("ab", "c", "abc"), ("a", "b", "ab")])


def test_decoder_holds_split_characters_back(codec, library):
    text = "naïve 😀 漢字"
    ids = ids_of(codec, text)
    for joined, want in ((True, library.decode(ids, skip_special_tokens=False)), (False, "naïve 😀 漢字 ")):
        machine = codec.decoder(joined)
        assert "".join([*(machine.push([i]) for i in ids), machine.close()]) == want
    machine = codec.decoder()
    assert [machine.push([i]) for i in ids_of(codec, "漢")][:1] == [""]
    assert codec.decode(np.array(ids_of(codec, "漢")[:1])) == "�"


def test_specials_as_ordinary_text(spark, codec):
    assert ids_of(codec, "a<|endoftext|>")[-1] == 49407
    assert 49407 not in ids_of(codec, "a<|endoftext|>", specials=False)
    df = spark.createDataFrame([(1, "a<|endoftext|>"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in wordbpe.decode(wordbpe.encode(df, specials=False)).collect()}
    assert got[1].decoded == "a <| endoftext |> " and got[2].ids == [] and got[2].decoded == ""
