"""python -m cairnfold contract [--format text|json]"""

from __future__ import annotations

import argparse

from .contract import as_json, as_text


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairnfold")
    contract = parser.add_subparsers(dest="command", required=True).add_parser("contract", help="what this engine claims")
    contract.add_argument("--format", choices=("text", "json"), default="text")
    print(as_json() if parser.parse_args(args).format == "json" else as_text())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
