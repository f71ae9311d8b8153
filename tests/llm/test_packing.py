import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(size - n)
        else:
            room.remove(fit)
            room.append(fit - n)
    return len(room)


def test_plan_is_best_fit_over_documents():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        slots = packing.plan(dict(Counter(lengths)), size)
        places = defaultdict(list)
        for n, rank, count, first, offset in slots.tolist():
            for k in range(count):
                places[first + k].append((offset, n))
        assert Counter(n for p in places.values() for _, n in p) == Counter(lengths)
        for p in places.values():
            p.sort()
            assert [o for o, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist()
            assert sum(n for _, n in p) <= size
        assert len(places) == best_fit(lengths, size)


def test_encoder_equals_the_library():
    lib = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ["", " ", "  a\n\n b", "don't we'll", "<|endoftext|> a<|endoftext|>", "日本語 é́ 12 ３", "\x85 a　b c ᠎ \x1c x", "x" * 9000, "ſ ǅ ²½ Ⅳ"]
    texts += ["".join(rng.choice(["a", "the", " ", "  ", "'s", "ü", "\n", "9", "_", "日", "\t", "​", "!"]) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    enc = packing.Encoder(PATH, cache=300)
    for t in texts:
        assert np.frombuffer(enc(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_pack_whole_documents(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (1, "a b c"), (4, "word " * 5000), (5, "x y " * 1023), (6, " ".join("tok" for _ in range(2047)))] + [(100 + i, "hot length") for i in range(300)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, length string")
    got = packing.pack(df, part_rows=80, least_parts=1).collect()
    assert got[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    want = []
    for d, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist() and sum(n for _, n in p) <= 2048
    assert len(places) == best_fit([w[3] for w in want], 2048)
    assert packing.pack(df.limit(0)).count() == 0


def test_very_long_white_space_equals_the_library():
    lib = Tokenizer.from_file(PATH)
    enc = packing.Encoder(PATH)
    n = 1_000_000
    for t in (" " * n, "a" + " " * n + "word  x", "\n" * n + "\tx", "don't " + "\u3000" * n + "1" + " \n" * 20_000, " \t" * n + " <|endoftext|> b"):
        assert np.array_equal(np.frombuffer(enc(t), "<u4"), lib.encode(t, add_special_tokens=False).ids)


def test_cuts_equal_the_library_in_all_scripts():
    lib = Tokenizer.from_file(PATH)
    enc = packing.Encoder(PATH)
    for at in range(0x80, 0x32000, 64):
        t = "".join(f"{c}{c}a{c}1{c} {c}!{c}  {c}\t" for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) < 0xE000)
        assert np.frombuffer(enc(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, hex(at)


def test_new_words_cost_little_more_than_their_merges():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60_000))

    def seconds(encode):
        began = time.process_time()
        encode(text)
        return time.process_time() - began

    plain = packing.Encoder(PATH).quick.encode_ordinary
    assert min(seconds(packing.Encoder(PATH)) for _ in range(3)) < 1.7 * min(seconds(plain) for _ in range(3))
