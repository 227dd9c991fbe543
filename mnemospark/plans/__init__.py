"""plans of mnemospark."""
