"""Where numbers come from: keys, running text and files."""
