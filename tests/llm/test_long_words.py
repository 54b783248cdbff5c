"""SentencePiece encoding of words without blanks: equal to the library, in time that grows with the length."""

import base64
import random
import time

import pytest
import sentencepiece
from ledgerweave.llm import piece_merges
from ledgerweave.llm.queries import model_path


@pytest.fixture(scope="module")
def merger():
    return piece_merges.Merger(piece_merges.read_vocabulary(model_path()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def kinds(library, n):
    rng = random.Random(n)
    pieces = [library.id_to_piece(i).replace("▁", "") for i in range(300, 20000)]
    draw = lambda letters: "".join(rng.choice(letters) for _ in range(n))
    return {
        "letters": draw("abcdefghijklmnopqrstuvwxyz"), "pieces": "".join(rng.choice(pieces) for _ in range(n))[:n], "base64": base64.b64encode(rng.randbytes(n)).decode()[:n],
        "han": draw("的一是在不了有和人这中大为上个国我以要他时来用们日本語のはにを가나다、。"), "equal": "a" * n, "pair": "ab" * (n // 2), "digits": draw("0123456789"),
        "mixed": " ".join(draw("the of 的一是\n==//ab")[: n // 4] for _ in range(4)), "odd": draw("aé😀́\u0000=x"),
    }


@pytest.mark.parametrize("n", [399, 400, 401, 5000, 30000])
def test_equal_to_the_library(merger, library, n):
    for kind, text in kinds(library, n).items():
        ((ids, decoded),) = merger.encode([text])
        assert [int(x) for x in ids.split()] == library.encode(text, add_eos=True), kind
        assert decoded == library.decode(library.encode(text)), kind


def test_heap_and_rounds_agree(merger, library):
    for text in kinds(library, 300).values():
        for word in text.split():
            assert merger.heaped(word).tolist() == merger.rounds([word])[0].tolist()


def test_time_grows_with_the_length(merger, library):
    """A million characters take seconds, and eight times the length well under thirty times the time."""
    for kind in ("letters", "pieces", "han"):
        seconds = []
        for n in (125_000, 1_000_000):
            text = kinds(library, n)[kind]
            began = time.process_time()
            merger.encode([text])
            seconds.append(time.process_time() - began)
        assert seconds[1] < 30 and seconds[1] < 30 * max(seconds[0], 0.05), kind
