"""Series operators. Windows run by source in time order; a NULL in a window or too few samples give NULL."""
