"""python -m millrace FOLDER: statements and commands from standard input, one a line, their results to standard output."""

from __future__ import annotations

import sys

from millrace.shell import Shell


def main() -> None:
    from millrace.functions.session import local_session

    if len(sys.argv) != 2:
        sys.exit(__doc__)
    shell = Shell(local_session(), sys.argv[1])
    for line in sys.stdin:
        if line.strip():
            out = shell.run(line)
            if out is not None:
                print(out, flush=True)
        if shell.ended:
            break
    shell.close()


if __name__ == "__main__":
    main()
