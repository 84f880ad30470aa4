"""Audio features and visual-word style vocabularies, in numpy; run on executors by sources.media_load."""

from __future__ import annotations

import hashlib
import io
import wave
from dataclasses import dataclass

import numpy as np

#: Parameters of the cepstral coefficients.
PRE_EMPHASIS, WINDOW_S, HOP_S, N_MEL, N_COEFFICIENTS, LOG_FLOOR = 0.97, 0.025, 0.010, 26, 13, 1e-10


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of a PCM WAV file."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(float) / (1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width}-bit samples are not supported")
    return x.reshape(-1, channels).mean(1), rate


def _mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def mel_filters(n_fft: int, rate: int) -> np.ndarray:
    edges = 700 * (10 ** (np.linspace(0, _mel(rate / 2), N_MEL + 2) / 2595) - 1)
    hz = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (hz - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-12)[:, None]
    down = (edges[2:, None] - hz) / np.maximum(edges[2:] - edges[1:-1], 1e-12)[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def mfcc(samples: np.ndarray, rate: int) -> np.ndarray:
    """One row of N_COEFFICIENTS per window; no row for a clip shorter than a window."""
    size, hop = int(round(WINDOW_S * rate)), int(round(HOP_S * rate))
    if len(samples) < size:
        return np.zeros((0, N_COEFFICIENTS), np.float32)
    x = np.append(samples[0], samples[1:] - PRE_EMPHASIS * samples[:-1])
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hamming(size)
    n_fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames, n_fft)) ** 2 / n_fft
    energy = np.log(np.maximum(power @ mel_filters(n_fft, rate).T, LOG_FLOOR))
    k, n = np.arange(N_COEFFICIENTS)[:, None], np.arange(N_MEL)
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * N_MEL)) * np.where(k == 0, np.sqrt(1 / N_MEL), np.sqrt(2 / N_MEL))
    return (energy @ basis.T).astype(np.float32)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of each point by Euclidean distance, the first of equals."""
    p, c = points.astype(float), centroids.astype(float)
    return ((c * c).sum(1) - 2 * p @ c.T).argmin(1)


def kmeans(points: np.ndarray, k: int, seed: int = 188, rounds: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Centroids: k-means++ start, Lloyd steps; an emptied cluster takes the worst represented point. The same
    seed gives the same result."""
    points = np.asarray(points, float)
    if not len(points):
        raise ValueError("no points to cluster")
    k = min(k, len(points))
    draw = np.random.default_rng(seed)
    centroids = points[[draw.integers(len(points))]]
    far = ((points - centroids[0]) ** 2).sum(1)
    while len(centroids) < k:
        pick = draw.choice(len(points), p=far / far.sum()) if far.sum() > 0 else draw.integers(len(points))
        centroids = np.vstack([centroids, points[pick]])
        far = np.minimum(far, ((points - points[pick]) ** 2).sum(1))
    for _ in range(rounds):
        label = nearest(points, centroids)
        moved = centroids.copy()
        error = ((points - centroids[label]) ** 2).sum(1)
        for j in range(k):
            mine = label == j
            if mine.any():
                moved[j] = points[mine].mean(0)
            else:
                worst = int(error.argmax())
                moved[j], error[worst] = points[worst], -1
        shift = np.abs(moved - centroids).max()
        centroids = moved
        if shift <= tol:
            break
    return centroids


@dataclass
class Vocabulary:
    """Centroids ("words") with inverse document frequencies."""

    centroids: np.ndarray
    idf: np.ndarray
    documents: int

    @property
    def fingerprint(self) -> str:
        return hashlib.blake2b(self.centroids.astype("<f4").tobytes() + self.idf.astype("<f8").tobytes(), digest_size=16).hexdigest()

    def histogram(self, descriptors: np.ndarray) -> np.ndarray:
        """Unit-length tf-idf histogram of words; the zero vector without descriptors."""
        if not len(descriptors):
            return np.zeros(len(self.centroids), np.float32)
        h = np.bincount(nearest(descriptors, self.centroids), minlength=len(self.centroids)) / len(descriptors) * self.idf
        norm = np.linalg.norm(h)
        return (h / norm if norm else h).astype(np.float32)

    def save(self, path: str) -> None:
        np.savez(path, centroids=self.centroids, idf=self.idf, documents=self.documents)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with np.load(path) as f:
            return cls(f["centroids"], f["idf"], int(f["documents"]))


def build_vocabulary(objects: list[np.ndarray], k: int, seed: int = 188) -> Vocabulary:
    """Words of the objects' descriptors; a word counts once per object that has it."""
    full = [o for o in objects if len(o)]
    centroids = kmeans(np.vstack(full), k, seed)
    df = np.zeros(len(centroids))
    for o in full:
        df[np.unique(nearest(o, centroids))] += 1
    return Vocabulary(centroids, np.where(df > 0, np.log(len(objects) / np.maximum(df, 1)), 0.0), len(objects))


def extract_features(name: str, data: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """Histogram of a media file, by its extension. Images need a decoder that is not available here: their
    descriptors must be computed elsewhere."""
    if not name.lower().endswith(".wav"):
        raise ValueError(f"{name}: only WAV audio can be decoded")
    return vocabulary.histogram(mfcc(*read_wav(data)))
