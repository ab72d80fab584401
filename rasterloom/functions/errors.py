"""Errors with a code. Column functions turn them into a status; nothing else leaves a row's function."""

from __future__ import annotations


class ImageError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def limit_error(message: str) -> ImageError:
    return ImageError("LIMIT", message)


def wrong_key() -> ImageError:
    return ImageError("WRONG_KEY", "the key does not match this image")
