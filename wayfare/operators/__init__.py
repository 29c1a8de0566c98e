"""Rules that turn query combinators into frames."""
