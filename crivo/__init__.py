"""crivo: credit-portfolio analytics as DataFrame-to-DataFrame operators on Spark."""
