"""Bounded samples drawn by digest."""

from __future__ import annotations


def under(eligible: int, wanted: int) -> str:
    """A hexadecimal digest that, with a wide margin, more than ``wanted`` of ``eligible`` digests are smaller than.

    Rows above it need not be sorted to find the ``wanted`` smallest, so what tasks hand to the driver does not grow with them.
    """
    share = (1.5 * wanted + 200) / max(1, eligible)
    return f"{int(share * (1 << 52)):013x}" if share < 1 else "g"
