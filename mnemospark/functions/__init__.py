"""functions of mnemospark."""
