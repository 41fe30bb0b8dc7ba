"""Developer tool: print the formatted physical plan of registered queries.

    python -m colloquy.plans.explain a15_account_impact [/root/testdata/sf0.1]
"""

from __future__ import annotations

import sys


def main(argv: list) -> None:
    from colloquy.plans import load_all
    from colloquy.session import get_session
    names = [a for a in argv if not a.startswith("/")]
    sf = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.01")
    spark = get_session("local[8]", 8)
    reg = load_all()
    for name in names:
        print(f"===== {name} @ {sf}")
        reg[name][0](spark, sf).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
