"""Every byte of a text reaches the image that its hash is taken from."""

import numpy as np
import pytest

from ledgerloom.llm import media_png


def reduced(samples):
    return media_png._averaged(media_png._averaged(samples.astype(np.float64), 1), 0)


@pytest.mark.parametrize("height", [1, 3, 31, 32, 37, 100])
def test_every_sample_changes_the_reduced_image(height):
    image = np.random.default_rng(height).integers(0, 256, (height, 64)).astype(np.uint8)
    before = reduced(image)
    assert before.shape == (32, 32)
    for y in range(height):
        for x in range(64):
            other = image.copy()
            other[y, x] ^= 255
            assert (reduced(other) != before).any()


def test_texts_that_differ_at_odd_places_have_other_hashes():
    r = np.random.default_rng(1)
    image = r.integers(97, 123, (12, 64)).astype(np.uint8)
    other = image.copy()
    other[:, 1::2] = r.integers(97, 123, (12, 32))
    assert media_png.perceptual_hash(image) != media_png.perceptual_hash(other)


def test_high_images_keep_their_hash():
    image = np.random.default_rng(2).integers(0, 256, (50, 64)).astype(np.uint8)
    ys = np.arange(32) * 50 // 32
    mean = np.array([[image[a:b, 2 * x : 2 * x + 2].mean() for x in range(32)] for a, b in zip(ys, [*ys[1:], 50], strict=True)])
    low = np.rint(media_png._COSINES @ mean @ media_png._COSINES.T * 1e6)
    assert media_png.perceptual_hash(image) == np.packbits(low.ravel() > np.median(low)).tobytes().hex()
