"""Lossless WebP: exact round trips through every feature of the format."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from lakescribe.llm import media, webp

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("kinds", [(), (0,), (1,), (2,), (3,), (0, 1), (2, 0), (1, 2, 0), (3, 0), (0, 1, 2)])
@pytest.mark.parametrize("cache", [0, 1, 5, 11])
def test_round_trip(kinds, cache):
    rng = np.random.default_rng(len(kinds) * 100 + cache)
    for h, w in ((1, 1), (1, 7), (5, 3), (17, 33)):
        for references in (False, True):
            for tile in (0, 2, 3):
                if webp.PALETTE in kinds:
                    colours = rng.integers(0, 256, (int(rng.choice([1, 2, 3, 4, 9, 16, 40])), 4))
                    pixels = colours[rng.integers(0, len(colours), (h, w))].astype(np.uint8)
                else:
                    pixels = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
                    pixels[h // 2 :] = pixels[0, 0]
                assert (webp.decode(webp.encode(pixels, kinds, cache, references, tile)) == pixels).all()


@pytest.mark.parametrize("kinds", [(), (0,), (1,), (2,), (0, 1, 2)])
@pytest.mark.parametrize("block", [2, 3, 5])
def test_round_trip_of_larger_images(kinds, block):
    rng = np.random.default_rng(block)
    pixels = np.cumsum(rng.integers(-3, 4, (45, 70, 4)), axis=1).astype(np.uint8)
    for cache in (0, 6):
        assert (webp.decode(webp.encode(pixels, kinds, cache, True, 0, block)) == pixels).all()


@pytest.mark.parametrize("shades", [1, 2, 3, 4, 9, 16, 17, 90, 256])
@pytest.mark.parametrize("encode", [webp.encode_grey, webp.encode_shades])
def test_grey(shades, encode):
    rng = np.random.default_rng(shades)
    for height in (1, 3, 40, 700):
        samples = rng.permutation(256).astype(np.uint8)[rng.integers(0, shades, (height, media.WIDTH))]
        samples[height // 3 : height // 2] = samples[:1]
        samples[height // 2 :, :64] = 255
        found = webp.decode_stream(encode(samples))
        assert (found[..., :3] == samples[..., None]).all() and (found[..., 3] == 255).all()


def test_broken():
    whole = media.to_media(media.payload_of("some text, and more of other words; " * 9 + "".join(map(chr, range(33, 120)))))
    for data in (b"", b"RIFF", whole[:40], whole[:12] + b"JUNK" + whole[16:], whole[:-60]):
        with pytest.raises(webp.BrokenImage):
            webp.decode(data)


def test_long_payload_is_several_images():
    payload = media.payload_of("x" * 1_500_000)
    stored = media.to_media(payload)
    images = list(media.read_media(stored))
    assert len(images) == 3 and media.samples_of(images) == payload and len(stored) < 2_000


def test_reader_takes_foreign_images():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 14, 4)).astype(np.uint8)
    found = list(media.read_media(webp.encode(pixels, (0, 2), 5, True) + media.to_media(media.payload_of("abc")) + webp.encode(pixels)))
    assert (found[0] == pixels).all() and media.samples_of(found[1:2]) == media.payload_of("abc") and (found[2] == pixels).all()


def test_repeated_text_is_short():
    payload = media.payload_of("the quick brown fox jumps over the lazy dog " * 400)
    assert len(media.to_media(payload)) * 10 < len(payload)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")
def test_given_texts_use_every_part(spark, monkeypatch):
    used = Counter()

    def counted(name):
        own = getattr(webp, name)

        def run(*args, **kwargs):
            used[name] += 1
            return own(*args, **kwargs)

        monkeypatch.setattr(webp, name, run)

    for name in ("read_code", "undo_predictor", "undo_cross_colour", "undo_palette", "_cache_slot", "_near"):
        counted(name)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").toLocalIterator():
        payload = media.payload_of(r["text"])
        assert media.samples_of(list(media.read_media(media.to_media(payload)))) == payload
    assert all(used[x] for x in ("read_code", "undo_predictor", "undo_cross_colour", "undo_palette", "_cache_slot", "_near")), used


def test_describe(odd_docs, no_docs):
    found = media.describe(media.store(odd_docs)).collect()
    assert len(found) == odd_docs.count()
    want = {r["doc_id"]: media.payload_of(r["text"]) for r in odd_docs.collect()}
    for r in found:
        p = want[r["doc_id"]]
        assert len(p) % 576 == 0 and (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    same = [r for r in found if r["doc_id"] in (5, 6)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert media.describe(media.store(no_docs)).count() == 0
    pixels = media.store(odd_docs).select("doc_id", media.pixel_column("media").alias("p")).collect()
    assert all(len(x["rgba"]) == 4 * x["height"] * x["width"] for r in pixels for x in r["p"])


def test_no_way_depends_on_the_size():
    """A long monotonous text is written in each way too: here that with a colour cache is the shortest."""
    y, x = np.mgrid[:100, : media.WIDTH]
    samples = (97 + x * y // 7 % 20).astype(np.uint8)
    assert samples.size > 1 << 14
    own = media.image_of(samples)
    assert len(own) < len(webp.riff(webp.encode_shades(samples)))
    assert media.samples_of(list(media.read_media(own))) == samples.tobytes()


def test_every_image_is_tried_in_each_way():
    """The shortest of three whole files, whatever the number of shades; before, one of more than 20 was never tried with a cache."""
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, n)) for n in (3, 60, 900, 4000)] + ["".join(map(chr, rng.integers(32, 32 + n, 3000))) for n in (2, 15, 21, 90)]
    won = Counter()
    for text in texts:
        samples = np.frombuffer(media.payload_of(text), np.uint8).reshape(-1, media.WIDTH)
        pixels = np.stack([samples, samples, samples, np.full_like(samples, 255)], axis=-1)
        shades = len(np.unique(samples))
        ways = [webp.riff(webp.encode_shades(samples)), webp.riff(webp.encode_grey(samples)), webp.encode(pixels, (), shades.bit_length(), True)]
        own = media.image_of(samples)
        assert own == min(ways, key=len)
        assert media.samples_of(list(media.read_media(own))) == samples.tobytes()
        won[ways.index(own), shades > 20] += 1
        for way, whole in zip((webp.shades_way(samples), webp.grey_way(samples), webp.cache_way(samples, shades.bit_length())), ways, strict=True):
            assert way.least <= way.size and webp.file_size(way.size) == len(whole) == len(webp.riff(way.stream()))
    assert won[2, True] and won[0, True], won


@pytest.mark.parametrize("cache", [1, 3, 6, 11])
@pytest.mark.parametrize("colours", [1, 3, 40, 400])
def test_images_with_a_cache_read_as_pixel_by_pixel(monkeypatch, cache, colours):
    rng = np.random.default_rng(colours + cache)
    own = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    own[0] = 0
    for h, w in ((1, 200), (40, 31), (70, 90)):
        pixels = own[rng.integers(0, colours, (h, w))]
        pixels[h // 2 :, w // 2 :] = pixels[0, 0]
        for references in (False, True):
            whole = webp.encode(pixels, (), cache, references)
            assert (webp.decode(whole) == pixels).all()
            with monkeypatch.context() as m:
                m.setattr(webp, "read_cached", lambda *_: None)
                assert (webp.decode(whole) == pixels).all()
            for cut in (60, len(whole) // 2):  # what is cut off is missed
                with pytest.raises(webp.BrokenImage):
                    webp.decode_stream(whole[20:][: len(whole) - 20 - cut])
