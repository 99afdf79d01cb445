"""python -m saldora init FOLDER | pages PATH FOLDER | questions PATH FOLDER

init writes the default checklist as JSON, pages the page texts of the files below a path, questions the numbered
questions in their texts, as Parquet."""

from __future__ import annotations

import sys

from saldora.session import session
from saldora.sources import checklists, files


def main(args: list[str]) -> int:
    if len(args) == 2 and args[0] == "init":
        checklists.default_checklist(session()).coalesce(1).write.mode("overwrite").json(args[1])
    elif len(args) == 3 and args[0] in ("pages", "questions"):
        pages = files.pages(files.binary_files(session(), args[1]))
        (pages if args[0] == "pages" else checklists.from_pages(pages.where("text is not null"))).write.mode("overwrite").parquet(args[2])
    else:
        print(__doc__, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
