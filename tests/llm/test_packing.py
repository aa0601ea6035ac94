import public_tokenizers
import pytest

from lagwise.llm import packing
from lagwise.llm.packing import _Words


@pytest.mark.parametrize("odd", [[], ["İx", "ﬁn", "中文字"]])
@pytest.mark.parametrize("ends", [True, False])
def test_words_learned_together_have_the_ids_they_have_alone(odd, ends):
    words = _Words(public_tokenizers.path("word_bpe_49k.json"))
    words.ends &= ends  # a vocabulary without ids that end a word
    texts = ["hello", "a", "zzqxj", "über", "über", "don't", "x1", "it's,", "•", "ab•c", "</w>", "", *odd]
    words.learn(set(texts))
    for text in texts:
        k = words[text]
        assert words.flat[words.cut[k] : words.cut[k + 1]].tolist() == words._ids([text])[0], text


def test_the_tokenizer_says_what_is_a_blank_and_what_is_lower_case(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = _Words(public_tokenizers.path("word_bpe_49k.json"))
    assert words.split("A b\nC") == ["a", "b", "c"]
    vocabulary = {c: i for i, c in enumerate(["a", "b", "c", "d", "A", "B", "C", "X", "x", "y", "z", ",", "\n", " ", "•"])}
    for cut in (pre_tokenizers.WhitespaceSplit(), None):
        tokenizer = Tokenizer(models.BPE(vocabulary, []))
        if cut:
            tokenizer.pre_tokenizer = cut
        file = str(tmp_path / f"{cut is None}.json")
        tokenizer.save(file)
        if cut:  # case matters to it, any white space is a blank
            assert _Words(file).split("A b\nC") == ["A", "b", "C"]
        else:  # a blank is a token of its own
            with pytest.raises(ValueError, match="apart"):
                _Words(file)


def test_words_used_most_are_kept_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE", 100)
    words, plain = packing._Words(public_tokenizers.path("word_bpe_49k.json")), packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    sizes = []
    for i in range(30):
        text = "the same words, always " * 3 + " ".join(f"once{i}x{j}" for j in range(20))
        got = packing.encoded([text], words)[0]
        want = plain.tokenizer.encode(text, add_special_tokens=False).ids
        assert got.tolist() == [*want, packing.END]
        sizes.append(len(words))
        assert "always" in words and len(words.cut) == len(words) + 1 and words.cut[-1] == len(words.flat)
    assert max(sizes) <= 125
    words.trim()
    assert 0 < len(words) <= 25 and "always" in words and "once29x1" not in words


def test_words_that_differ_in_marks_and_case_are_tokenized_once(monkeypatch):
    words, seen = packing._Words(public_tokenizers.path("word_bpe_49k.json")), []
    monkeypatch.setattr(words, "_ids", lambda texts, ids=words._ids: seen.extend(texts) or ids(texts))
    packing.encoded(['Wonder wonder, wonder. WONDER! wonder?" (wonder', "né né, né. été; wonder"], words)
    given = " ".join(seen).split()
    assert given.count("wonder") == 1 and given.count("né") == 1 and not {"wonder,", "wonder.", "né,"} & {*given}


@pytest.mark.parametrize("chars", [5, 40, 500_000])
def test_texts_have_the_ids_that_the_tokenizer_gives_them(chars, monkeypatch):
    monkeypatch.setattr(packing, "_CHARS", chars)
    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["'", "'s", "'S,", "don't,", "dogs'", "a's'.", "rock'n'roll!!", ",'s", "…", "a…,", "é,", "É.", "×,", "3×,", "÷.", "x1,", "12.", "J̌", "ǰ,", "İx,", "ﬁn.", "Σας,", "\x00", "a\x00", "a", "́,", "ɐ,", "名前,", "•,", "a•,", "\t,a\t.", " b,", "</w>,", "<|endoftext|>,"]
    odd += [c * n + end for c in ("a", "é", "名") for n in (7, 8, 11, 12, 15, 16, 17, 22, 23, 24, 25, 300) for end in ("", ",", "....", ".....,")]
    plain = [" ".join(odd), *odd, "\n".join(odd), "  ".join(odd).upper(), "", " ", "\n \n", " ".join(x for x in odd if x.isascii()).title()]
    for texts in (plain, plain[::-1]):
        want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in packing.encoded(texts, words)] == [[*ids, packing.END] for ids in want]


def test_words_whose_keys_have_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing, "_hash", lambda keys: keys[:, 0] % packing.np.uint64(2))
    words = packing._Words(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"word{i}, other{i}" for i in range(40))
    for _ in range(2):
        assert packing.encoded([text], words)[0].tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
