"""What rows cost when billed by the million."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Estimate:
    rows: int
    vendor: float
    self_host: float

    @property
    def saved(self) -> float:
        return self.vendor - self.self_host

    @property
    def fraction(self) -> float | None:
        return self.saved / self.vendor if self.vendor > 0 else None

    def text(self) -> str:
        part = f" ({100 * self.fraction:.1f}%)" if self.fraction is not None else ""
        return f"rows={self.rows} vendor=${self.vendor:.2f} self_host=${self.self_host:.2f} saved=${self.saved:.2f}{part}"


def estimate(rows: int, vendor_per_million: float, self_host: float = 0.0) -> Estimate:
    return Estimate(rows, rows / 1e6 * vendor_per_million, self_host)
