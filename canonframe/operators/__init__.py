"""Set operators over documents."""
