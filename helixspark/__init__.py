"""Analytics over genome-wide association summary statistics: relational work as DataFrame plans, small matrices on the driver."""
