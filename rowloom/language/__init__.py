"""The program text front end: macro stage, tokens, parser."""
