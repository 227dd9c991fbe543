"""operators of mnemospark."""
