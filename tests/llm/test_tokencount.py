import random

import public_tokenizers
import sentencepiece

from lodestone.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c ", "\t\n a\nb", "<s>x</s> <unk>", "▁x", "a▁b", "a ▁ b", "日本語 テキスト", "é́", "\x00a \x00", "x" * 5000, " " * 3000, "ab" * 700 + " " + "c d " * 900, "😀 😀", "　a b", "<0x41> 12 3.4"]


def test_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", "  ", "er", "ü", "\n", "9", "▁", "日"]) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    want = [len(x) for x in sp.encode(texts)]
    for chunk in (7, 64, 1024):
        assert tokencount.count_texts(tokencount.Transducer(PATH, 1 << 14), texts, chunk) == want
    assert tokencount.count_texts(tokencount.Transducer(PATH), texts, 64, 0) == want
    # Tables that are dropped again and again.
    small = tokencount.Transducer(PATH, 3000)
    assert [tokencount.count_texts(small, [t])[0] for t in texts] == want


def test_no_text_is_given_to_the_library(monkeypatch):
    machine = tokencount.Transducer(PATH)
    monkeypatch.setattr(tokencount.sentencepiece, "SentencePieceProcessor", None)
    assert tokencount.count_texts(machine, ["the cat", "中文" * 400]) == [2, 801]


def test_transitions_close_up_tokens():
    machine, total = tokencount.Transducer(PATH), 0
    state, changes = 0, []
    for c in " international":
        state, change = machine.transition(state, int(machine.symbol[ord(c)]))
        total += change
        changes.append(change)
    assert total == 1 and min(changes) < 0


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "a b", 3), (1, None, 2), (2, "x " * 5000, 0)], "doc_id long, text string, n_tokens long")
    assert sorted(map(tuple, tokencount.token_counts(df).collect()), key=str) == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (2, 10000, 5001, True)], key=str)
    assert tokencount.token_counts(df.limit(0)).count() == 0
