"""Pixel operators on numpy arrays (height, width, channels), uint8. No Spark here.

Kernels are the published formulas; when an axis shrinks they are stretched by the shrink factor, and weights
are normalised. Resampling is separable and in gamma space, with an option for linear light.
"""

from __future__ import annotations

import unicodedata

import numpy as np

RADIUS = {"lanczos": 3.0, "catmull-rom": 2.0, "bilinear": 1.0, "mks2021": 4.5}


def kernel(name: str, x: np.ndarray) -> np.ndarray:
    """The kernel's value at distances x (in output steps)."""
    x = np.abs(np.asarray(x, float))
    if name == "bilinear":
        return np.maximum(0.0, 1 - x)
    if name == "catmull-rom":
        return np.select([x < 1, x < 2], [1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2], 0.0)
    if name == "lanczos":
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    if name == "mks2021":
        return np.select(
            [x <= 0.5, x <= 1.5, x <= 2.5, x <= 3.5, x <= 4.5],
            [577 / 576 - 239 / 144 * x**2, 35 / 36 * (x - 1) * (x - 239 / 140), (x - 2) * (65 / 24 - x) / 6, (x - 3) * (x - 15 / 4) / 36, -((x - 9 / 2) ** 2) / 288],
            0.0,
        )
    raise ValueError(f"unknown filter: {name}")


def taps(n_in: int, n_out: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """For each output sample the input samples that count and their weights (n_out, taps); edges repeat the last sample."""
    ratio = n_in / n_out
    stretch = max(1.0, ratio)
    centre = (np.arange(n_out) + 0.5) * ratio - 0.5
    reach = int(np.ceil(RADIUS[name] * stretch)) + 1
    at = np.floor(centre)[:, None].astype(int) + np.arange(-reach, reach + 1)
    w = kernel(name, (at - centre[:, None]) / stretch)
    return np.clip(at, 0, n_in - 1), w / w.sum(1, keepdims=True)


def weights(n_in: int, n_out: int, name: str) -> np.ndarray:
    """The same as a matrix (n_out, n_in)."""
    at, w = taps(n_in, n_out, name)
    out = np.zeros((n_out, n_in))
    np.add.at(out, (np.repeat(np.arange(n_out), at.shape[1]), at.ravel()), w.ravel())
    return out


def fit_size(w: int, h: int, box_w: int, box_h: int) -> tuple[int, int]:
    scale = min(box_w / w, box_h / h)
    return max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))


def _apply(image: np.ndarray, n_out: int, name: str) -> np.ndarray:
    """Resamples the first axis, tap by tap: memory is that of the result, whatever the input's length."""
    at, w = taps(image.shape[0], n_out, name)
    out = np.zeros((n_out, *image.shape[1:]))
    for k in range(at.shape[1]):
        if w[:, k].any():
            out += w[:, k, None, None] * image[at[:, k]]
    return out


def resize(image: np.ndarray, width: int, height: int, name: str = "mks2021", linear_light: bool = False) -> np.ndarray:
    x = image.astype(float)
    if linear_light:
        x = x / 255
        x = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    x = _apply(x, height, name)
    x = _apply(x.transpose(1, 0, 2), width, name).transpose(1, 0, 2)
    if linear_light:
        x = np.clip(x, 0, 1)
        x = 255 * np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resize_to_fit(image: np.ndarray, box_w: int, box_h: int, name: str = "mks2021", linear_light: bool = False) -> np.ndarray:
    return resize(image, *fit_size(image.shape[1], image.shape[0], box_w, box_h), name, linear_light)


def add_frame(image: np.ndarray, top: int, right: int, bottom: int, left: int, colour: tuple[int, int, int]) -> np.ndarray:
    h, w, c = image.shape
    out = np.empty((h + top + bottom, w + left + right, c), np.uint8)
    out[:] = np.array(colour[:c], np.uint8)
    out[top : top + h, left : left + w] = image
    return out


def fill(image: np.ndarray, left: int, top: int, width: int, height: int, colour: tuple[int, int, int]) -> np.ndarray:
    if width > 0 and height > 0:
        image[max(0, top) : top + height, max(0, left) : left + width] = np.array(colour[: image.shape[2]], np.uint8)
    return image


# A 5 x 7 dot font, a row of bits for each line, top first. Small letters show as capitals, letters with accents
# without them, other characters as a box.
_FONT = """
A 01110 10001 10001 11111 10001 10001 10001
B 11110 10001 10001 11110 10001 10001 11110
C 01110 10001 10000 10000 10000 10001 01110
D 11110 10001 10001 10001 10001 10001 11110
E 11111 10000 10000 11110 10000 10000 11111
F 11111 10000 10000 11110 10000 10000 10000
G 01110 10001 10000 10111 10001 10001 01111
H 10001 10001 10001 11111 10001 10001 10001
I 01110 00100 00100 00100 00100 00100 01110
J 00111 00010 00010 00010 00010 10010 01100
K 10001 10010 10100 11000 10100 10010 10001
L 10000 10000 10000 10000 10000 10000 11111
M 10001 11011 10101 10101 10001 10001 10001
N 10001 11001 10101 10011 10001 10001 10001
O 01110 10001 10001 10001 10001 10001 01110
P 11110 10001 10001 11110 10000 10000 10000
Q 01110 10001 10001 10001 10101 10010 01101
R 11110 10001 10001 11110 10100 10010 10001
S 01111 10000 10000 01110 00001 00001 11110
T 11111 00100 00100 00100 00100 00100 00100
U 10001 10001 10001 10001 10001 10001 01110
V 10001 10001 10001 10001 10001 01010 00100
W 10001 10001 10001 10101 10101 11011 10001
X 10001 10001 01010 00100 01010 10001 10001
Y 10001 10001 01010 00100 00100 00100 00100
Z 11111 00001 00010 00100 01000 10000 11111
0 01110 10001 10011 10101 11001 10001 01110
1 00100 01100 00100 00100 00100 00100 01110
2 01110 10001 00001 00010 00100 01000 11111
3 11111 00010 00100 00010 00001 10001 01110
4 00010 00110 01010 10010 11111 00010 00010
5 11111 10000 11110 00001 00001 10001 01110
6 00110 01000 10000 11110 10001 10001 01110
7 11111 00001 00010 00100 01000 01000 01000
8 01110 10001 10001 01110 10001 10001 01110
9 01110 10001 10001 01111 00001 00010 01100
. 00000 00000 00000 00000 00000 01100 01100
, 00000 00000 00000 00000 01100 00100 01000
- 00000 00000 00000 11111 00000 00000 00000
: 00000 01100 01100 00000 01100 01100 00000
! 00100 00100 00100 00100 00100 00000 00100
? 01110 10001 00001 00010 00100 00000 00100
; 00000 01100 01100 00000 01100 00100 01000
' 00100 00100 01000 00000 00000 00000 00000
" 01010 01010 01010 00000 00000 00000 00000
( 00010 00100 01000 01000 01000 00100 00010
) 01000 00100 00010 00010 00010 00100 01000
/ 00000 00001 00010 00100 01000 10000 00000
+ 00000 00100 00100 11111 00100 00100 00000
= 00000 00000 11111 00000 11111 00000 00000
& 01100 10010 10100 01000 10101 10010 01101
# 01010 01010 11111 01010 11111 01010 01010
% 11000 11001 00010 00100 01000 10011 00011
_ 00000 00000 00000 00000 00000 00000 11111
@ 01110 10001 00001 01101 10101 10101 01110
* 00000 00100 10101 01110 10101 00100 00000
"""
GLYPHS = {line[0]: np.array([[int(b) for b in row] for row in line.split()[1:]], bool) for line in _FONT.strip().splitlines()}
BOX = np.pad(np.zeros((5, 3), bool), 1, constant_values=True)


def draw_text(image: np.ndarray, text: str, left: int, top: int, font: int, right: int | None = None) -> np.ndarray:
    """Black text from the given corner, scaled to about the font's size, cut at `right` and the image's edges."""
    dot = max(1, font // 9)
    right = image.shape[1] if right is None else min(right, image.shape[1])
    for ch in text:
        base = unicodedata.normalize("NFD", ch)[0].upper()
        glyph = np.zeros((7, 5), bool) if ch.isspace() else GLYPHS.get(base, BOX)
        big = np.kron(glyph, np.ones((dot, dot), bool))[: max(0, image.shape[0] - top), : max(0, right - left)]
        if left >= right:
            break
        image[top : top + big.shape[0], left : left + big.shape[1]][big] = 0
        left += 6 * dot
    return image


def label_geometry(text: str, font: int, canvas_w: int, canvas_h: int, left: int, image_bottom: int, padding: int) -> dict:
    """The caption's box; the same numbers as functions.geometry.label_box."""
    tw, th, pad = int(len(text.encode()) * float(font) * 0.6), int(font * 1.35), font // 3
    top, x = max(0, image_bottom + padding), max(0, left - pad // 2)
    bw, bh = min(tw + 2 * pad, canvas_w - x), min(th + pad, canvas_h - top)
    return {"box_left": x, "box_top": top, "box_width": bw, "box_height": bh, "text_left": x + pad // 2, "text_top": top + pad // 2}


def add_label(image: np.ndarray, text: str, font: int, left: int, image_bottom: int, padding: int) -> np.ndarray:
    """A white box with black text below the picture; an empty text draws nothing."""
    if not text:
        return image
    g = label_geometry(text, font, image.shape[1], image.shape[0], left, image_bottom, padding)
    if g["box_width"] > 0 and g["box_height"] > 0:
        fill(image, g["box_left"], g["box_top"], g["box_width"], g["box_height"], (255, 255, 255))
        draw_text(image, text, g["text_left"], g["text_top"], font)
    return image
