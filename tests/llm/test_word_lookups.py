import public_tokenizers
import pyarrow as pa

from loamlog.llm.tokens import WordEncoder


class Counted(dict):
    n = 0

    def get(self, *args):
        self.n += 1
        return super().get(*args)

    def __contains__(self, word):
        self.n += 1
        return super().__contains__(word)

    def __getitem__(self, word):
        self.n += 1
        return super().__getitem__(word)


def test_a_known_word_is_looked_up_once_a_slice():
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["Some words, some more; and some...", "words again!"])
    ids, counts = encoder.encode(texts)
    encoder.slots = Counted(encoder.slots)
    again, lengths = encoder.encode(texts)
    assert again.tolist() == ids.tolist() and lengths.tolist() == counts.tolist()
    assert encoder.slots.n <= 5 + 5  # some, words, more, and, again; and the tails , ; ... ! and none
