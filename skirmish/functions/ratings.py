"""Rating formulas as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# fixed values of the rating model
K, SCALE, START, MARGIN = 74.0, 1000.0, 1000.0, 5.95


@dataclass(frozen=True)
class RatingModel:
    """The model's constants, and its update for one game; a fold, a stream, a function
    of the session and the reference SQL can each be given one."""

    k: float = K
    scale: float = SCALE
    start: float = START
    margin: float = MARGIN

    def __post_init__(self) -> None:
        if self.k <= 0 or self.scale <= 0 or self.margin <= 1:
            raise ValueError("k and scale must be above 0, margin above 1")

    def chance(self, own: float, other: float) -> float:
        return 1 / (1 + 10 ** ((other - own) / self.scale))

    def gain(self, winner: float, loser: float, rounds_ahead: float) -> float:
        return self.k * math.log(self.margin * math.sqrt(max(rounds_ahead, 0) + 1)) * (1 - self.chance(winner, loser))


DEFAULT = RatingModel()


def win_chance(own: Column, other: Column, model: RatingModel = DEFAULT) -> Column:
    """Chance of the side rated ``own``."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / model.scale))


def margin_factor(rounds_ahead: Column, model: RatingModel = DEFAULT) -> Column:
    return F.ln(F.lit(model.margin) * F.sqrt(F.greatest(rounds_ahead, F.lit(0)) + 1))


def rating_gain(winner: Column, loser: Column, rounds_ahead: Column, model: RatingModel = DEFAULT) -> Column:
    """What the winner gains and the loser loses."""
    return model.k * margin_factor(rounds_ahead, model) * (1 - win_chance(winner, loser, model))


def best_of_3(a: Column, b: Column, c: Column) -> Column:
    return a * b + a * (1 - b) * c + (1 - a) * b * c


def best_of_5(chances: list[Column], one: Column | float | None = None, none: Column | float | None = None) -> Column:
    """Chance to win three of five games of these chances, by summing over the
    distribution of wins game by game. With the numbers ``one`` and ``none`` for columns
    of a constant, arrays do as well."""
    one, none = (F.lit(1.0), F.lit(0.0)) if one is None else (one, none)
    wins = [one] + [none] * 5
    for p in chances:
        wins = [(wins[i] * (1 - p) + (wins[i - 1] * p if i else none)) for i in range(6)]
    return wins[3] + wins[4] + wins[5]
