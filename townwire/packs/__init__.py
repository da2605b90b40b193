"""Rule packs and lexicons as data."""

from pathlib import Path

HERE = Path(__file__).parent
