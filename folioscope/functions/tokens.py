"""Token counts of a vocabulary file, for chunk sizes and budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Distinct pre-tokens whose counts a task remembers.
MAX_KNOWN = 500_000


@dataclass(eq=False)
class Vocabulary:
    """A tokenizer hook for ``n_tokens``: ``path`` is the file of a ``tokenizers`` vocabulary, on every node or shared.

    A batch of texts is cut into pre-tokens first and each distinct one is counted once a task; most of a text is words that came
    before. Texts that name a special token, and vocabularies without pre-tokens, go to the library whole.
    """

    path: str
    known: dict[str, int] = field(default_factory=dict, repr=False)
    _loaded: object = field(default=None, repr=False)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Vocabulary) and self.path == other.path

    def __getstate__(self) -> dict:
        return {"path": self.path, "known": {}, "_loaded": None}

    def _tokenizer(self):
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(self.path)
        return self._loaded

    def __call__(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of every text; 0 for null."""
        tokenizer = self._tokenizer()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        normal, cut, model, known = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model, self.known
        out = []
        for text in texts:
            if not text:
                out.append(0)
            elif cut is None or any(s in text for s in special):
                out.append(len(self(text)))
            else:
                total = 0
                for piece, _ in cut.pre_tokenize_str(normal.normalize_str(text) if normal else text):
                    n = known.get(piece)
                    if n is None:
                        if len(known) >= MAX_KNOWN:
                            known.clear()
                        n = known[piece] = len(model.tokenize(piece))
                    total += n
                out.append(total)
        return out
