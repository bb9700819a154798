"""op2 on texts of fewer than 128 tokens."""
import random

from harborline.llm import fertility


def test_short_symbol_runs_are_rejected_and_prose_kept():
    v = fertility._vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model", None)
    rnd = random.Random(3)
    junk = " ".join(rnd.choice(["%%%", "&&&", "###", "|", "***", "$$"]) for _ in range(40)).encode()
    prose = (b"The harbour was quiet in the early morning, and only two small boats came back with "
             b"their catch before the rain began to fall on the old stone wall near the market square.")
    for raw, kept in ((junk, False), (prose, True)):
        p = fertility.profile(raw, "en", v, fertility.BANDS)
        assert not p[5] and 32 <= p[7] < 128 and p[6] is kept


def test_short_texts_meet_every_band():
    for band in fertility.BANDS.values():
        per_token = (band.min_chars_per_token + band.max_chars_per_token) / 2
        assert band.accepts(20, per_token, 0.0, 3.0)
        assert not band.accepts(20, band.min_chars_per_token / 2, 0.0, 3.0)
        assert not band.accepts(20, per_token, 0.9, 3.0)
        assert band.accepts(100, per_token, 0.0, 5.6) and not band.accepts(100, per_token, 0.0, 1.0)
