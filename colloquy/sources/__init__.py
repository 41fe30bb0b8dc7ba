from colloquy.sources.tables import table  # noqa: F401
from colloquy.sources.meetings import meetings_raw, competitor_accounts  # noqa: F401
