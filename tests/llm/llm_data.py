"""Texts made from a seed."""

import random

WORDS = ("the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an "
         "your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time "
         "could no make than first been its who now people my made over did down only way find use may water long little very after words called just "
         "where most know get through back much before go good new write our used me man too any day same right look think also around another came come "
         "work three word must because does part even place well such here take why things help put years different away again off went old number").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))
