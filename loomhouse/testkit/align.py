"""python -m loomhouse.testkit.align FILE LINE: align the drawn table around a line of a file, in place."""

import sys
from pathlib import Path

from .drawn import align


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__)
        return 1
    path = Path(args[0])
    text = path.read_text()
    path.write_text(align(text, int(args[1]) - 1) + ("\n" if text.endswith("\n") else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
