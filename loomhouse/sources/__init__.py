"""Sources, and sources that transform or combine others."""
